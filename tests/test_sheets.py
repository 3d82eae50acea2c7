from pyspark.sql import functions as F

from tessera.sources import sheets


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


SHEET = """lead
GO Базы данных
skip
 17 18  грейд   15 мин   3 раза
Что такое  индекс?

 второй абзац
Ответ
дерево
Ответ
ещё
Скрининг 5 мин 2 раз
Коротко
"""


def test_tasks(spark):
    got = one(spark, SHEET, lambda t: sheets.tasks(t, sheets.GRADED))
    assert [tuple(r) for r in got] == [
        (3, "grades", "Базы данных", ["17", "18"], 15, 3, "Что такое  индекс?\n\n второй абзац", "дерево\nОтвет\nещё"),
        (11, "screening", "Базы данных", [], 5, 2, "Коротко", ""),
    ]


def test_sections_are_near(spark):
    far = "GO Архитектура\n" + "x\n" * 12 + "Грейд неизвестен 4 раз\nbody"
    assert one(spark, far, lambda t: sheets.tasks(t, sheets.GRADED))[0].section == "Архитектура"
    got = one(spark, "x\n" + far.replace("x\n", "x\nx\n", 1), lambda t: sheets.tasks(t, sheets.GRADED))
    assert [(r.kind, r.section, r.used, r.minutes) for r in got] == [("unknown", None, 4, None)]
    assert one(spark, "no header\nat all", lambda t: sheets.tasks(t, sheets.GRADED)) == [] and one(spark, None, lambda t: sheets.tasks(t, sheets.GRADED)) == []
    assert [r.line for r in one(spark, "Скрининг 5 мин 2 раз\nСкрининг 6 мин 1 раз", lambda t: sheets.tasks(t, sheets.GRADED))] == [0, 1]


BLOCKS = """before
Рекомендуемые задачи
Rate limiter (medium)
Design it.

- first
Basic:
- counts
● windows
Expert
deep
Теоретические вопросы 2
Вопрос №1 What is
a wrapped
  title?

• point one
Advanced
– point two
Вопрос №2 Bare
"""


def test_blocks(spark):
    a, b, c = one(spark, BLOCKS, sheets.blocks)
    assert (a.line, a.kind, a.title, a.difficulty) == (1, "task", "Rate limiter", "medium")
    assert [tuple(r) for r in a.rubric] == [("Ожидания", "Design it.\nfirst"), ("Basic", "counts\nwindows"), ("Expert", "deep")]
    assert a.body == "Design it.\n\n- first\nBasic:\n- counts\n● windows\nExpert\ndeep"
    assert (b.kind, b.title, b.difficulty) == ("question", "What is a wrapped title?", None)
    assert [tuple(r) for r in b.rubric] == [("Ожидания", "point one"), ("Advanced", "point two")]
    assert (c.title, c.body, c.rubric) == ("Bare", "", [])


def test_numbered(spark):
    text = "System Design Tasks\n1.\nShort links\n  Build it.\nОтвет\n17 грейд\n hash\n18 грейд\nshard\n it\n2.\nCache\nOnly a condition\n"
    got = one(spark, text, lambda t: sheets.numbered(t, skipped=("System Design Tasks",)))
    assert [(r.number, r.title, r.condition, [tuple(x) for x in r.rubric]) for r in got] == [(1, "Short links", "Build it.", [("17", "hash"), ("18", "shard\nit")]), (2, "Cache", "Only a condition", [])]


def test_work_of_many_tasks_grows_with_the_text(spark):
    """Two thousand tasks in one text: cleaned once a text, not once a task, which took minutes; further fields from lines and the answer's place."""
    import time

    text = "\n".join(f"Скрининг {i % 60} мин 1 раз\nline {i}\nОтвет\nyes" for i in range(2000))
    count = lambda body, cut: {"n": F.size(body), "cut": cut}
    began = time.time()
    got = one(spark, text, lambda t: sheets.tasks(t, sheets.GRADED, count))
    assert [(r.line, r.minutes, r.condition, r.answers, r.n, r.cut) for r in got] == [(4 * i, i % 60, f"line {i}", "yes", 3, 1) for i in range(2000)]
    assert time.time() - began < 60
