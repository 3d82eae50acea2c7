"""Tasks in plain text, as it comes out of sheets and documents: sessions of lines that a header opens and the next one ends.

A text is an array of lines; what each line is follows from the line alone, where sessions begin from the places of headers, and a session is a slice between two of them. So the
whole extraction is column expressions over one row: no line is shuffled, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.variants import let


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def cleaned(line: Column) -> Column:
    """White space of any kind collapsed and cut off at both ends."""
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def places(flags: Column) -> Column:
    """The numbers, from 0, of the entries that are true."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def between(lines: Column, a: Column, b: Column) -> Column:
    """Lines a to b - 1."""
    return F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))


def sessions(lines: Column, heads: Column) -> Column:
    """array<struct<head int, body array<string>>>: for each head (place of a line) the lines up to the next one. Lines before the first head are in none."""
    ends = F.slice(F.concat(heads, F.array(F.size(lines))), F.lit(2), F.size(heads))
    return F.zip_with(heads, ends, lambda h, e: F.struct(h.alias("head"), between(lines, h + 1, e).alias("body")))


def first_place(lines: Column, holds) -> Column:
    """The number of the first line for which ``holds``; that behind the last if there is none."""
    return F.coalesce(F.get(places(F.transform(lines, holds)), F.lit(0)), F.size(lines))


def joined(lines: Column) -> Column:
    """Lines with trailing blanks cut off, without blank lines at either end."""
    text = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.regexp_replace(text, r"^\n+|\n+$", "")


@dataclass(frozen=True)
class TaskSheet:
    """How the headers of tasks look, as patterns found in cleaned lines. headers: kind to pattern, the first that is found counts; groups of a pattern are named in ``fields``.
    section: pattern of a line above a header, at most ``back`` lines before it, whose first group names the section. answer: the cleaned line that begins the answers."""

    headers: tuple[tuple[str, str], ...]
    fields: tuple[tuple[str, tuple[tuple[str, int], ...]], ...]
    section: str
    answer: str
    back: int = 13


# The words of the sheets' format.
GRADED = TaskSheet(
    (("grades", r"((?:\d{2}\s*)+)грейд\s+(\d+)\s*мин\s+(\d+)\s*(?:раз|раза)?"), ("screening", r"Скрининг\s+(\d+)\s*мин\s+(\d+)\s*(?:раз|раза)?"), ("unknown", r"Грейд неизвестен\s+(\d+)\s*(?:раз|раза)?")),
    (("grades", (("grades", 1), ("minutes", 2), ("used", 3))), ("screening", (("minutes", 1), ("used", 2))), ("unknown", (("used", 1),))),
    r"GO\s+(.+?)\s*$",
    "Ответ",
)


def tasks(text: Column, sheet: TaskSheet, more: Callable[[Column, Column], dict[str, Column]] = lambda body, cut: {}) -> Column:
    """array<struct<line, kind, section, grades array<string>, minutes int, used int, condition, answers>> of a text, in order; none of a null one.

    A task reaches from its header to the next one of any kind. The section is that of the nearest section line above the header, if one is close enough, whatever stands between. What precedes the answer
    line is the condition; later answer lines are lines of the answers. ``more`` names further fields by a task's lines and the place of its answer line, the number of lines if it has none.

    Lines are cut and cleaned once a text, and headers found once, so that the work grows with the text and not with its lines times its tasks.
    """
    kind = lambda x: F.coalesce(*[F.when(x.rlike(p), k) for k, p in sheet.headers])
    section = lambda x: F.nullif(F.regexp_extract(x, sheet.section, 1), F.lit(""))
    named = dict(sheet.fields)

    def field(x: Column, name: str) -> Column:
        got = [F.when(kind(x) == k, F.regexp_extract(x, p, dict(named[k])[name])) for k, p in sheet.headers if name in dict(named[k])]
        return F.coalesce(*got, F.lit(None).cast("string"))

    def task(lines: Column, s: Column, head: Column, cut: Column) -> Column:
        body = s["body"]
        above = F.filter(F.transform(between(lines, F.greatest(s["head"] - sheet.back, F.lit(0)), s["head"]), section), lambda x: x.isNotNull())
        return F.struct(
            s["head"].alias("line"),
            kind(head).alias("kind"),
            F.try_element_at(above, F.lit(-1)).alias("section"),
            F.coalesce(F.regexp_extract_all(field(head, "grades"), F.lit(r"(\d{2})")), F.array().cast("array<string>")).alias("grades"),
            field(head, "minutes").try_cast("int").alias("minutes"),
            field(head, "used").try_cast("int").alias("used"),
            joined(between(body, F.lit(0), cut)).alias("condition"),
            joined(between(body, cut + 1, F.size(body))).alias("answers"),
            *[c.alias(n) for n, c in more(body, cut).items()],
        )

    def of(x: Column) -> Column:
        lines, clean = x["lines"], x["clean"]
        cut = lambda s: F.coalesce(F.get(places(F.transform(between(clean, s["head"] + 1, s["head"] + 1 + F.size(s["body"])), lambda y: y == sheet.answer)), F.lit(0)), F.size(s["body"]))
        one = lambda s: let(F.struct(F.get(clean, s["head"]).alias("head"), cut(s).alias("cut")), lambda y: task(lines, s, y["head"], y["cut"]))
        return let(places(F.transform(clean, lambda y: kind(y).isNotNull())), lambda heads: F.transform(sessions(lines, heads), one))

    return let(lines_of(text), lambda lines: let(F.struct(lines.alias("lines"), F.transform(lines, cleaned).alias("clean")), of))


@dataclass(frozen=True)
class BlockSheet:
    """Blocks of two kinds. task: header with title and difficulty as groups; question: header whose group begins a title that may be wrapped over lines; rubric: head of a rubric, its label as group;
    bullet: mark at the begin of a bullet; skipped: cleaned lines, or their begins, that are in no block."""

    task: str = r"^(.{3,80}?)\s*\((easy|medium|hard)\)\s*$"
    question: str = r"^Вопрос №\d+\s+(.*)$"
    rubric: str = r"^(Basic|Advanced|Expert|Начальный|Средний|Продвинутый|0 баллов|1 балл|3 балла)\s*:?\s*$"
    bullet: str = r"^[●○•\-–]"
    skipped: tuple[str, ...] = ("Рекомендуемые задачи", "Теоретические вопросы")
    expected: str = "Ожидания"


def blocks(text: Column, sheet: BlockSheet = BlockSheet()) -> Column:
    """array<struct<line, kind, title, difficulty, body, rubric array<struct<label, text>>>> of a text, in order.

    The title of a question goes on over the lines behind it, until a bullet, a rubric's head or the block's end.
    """
    lines = F.filter(lines_of(text), lambda x: ~_starts(cleaned(x), sheet.skipped))
    clean = F.transform(lines, cleaned)

    def block(s: Column) -> Column:
        head, body = F.get(clean, s["head"]), s["body"]
        own = head.rlike(sheet.task)
        stop = first_place(body, lambda x: cleaned(x).rlike(sheet.rubric) | cleaned(x).rlike(sheet.bullet))
        more = F.filter(F.transform(between(body, F.lit(0), stop), cleaned), lambda x: x != "")
        title = F.array_join(F.concat(F.array(F.trim(F.regexp_extract(head, sheet.question, 1))), more), " ")
        rest = F.when(own, body).otherwise(between(body, stop, F.size(body)))
        return F.struct(
            s["head"].alias("line"),
            F.when(own, "task").otherwise("question").alias("kind"),
            F.when(own, F.trim(F.regexp_extract(head, sheet.task, 1))).otherwise(title).alias("title"),
            F.when(own, F.regexp_extract(head, sheet.task, 2)).alias("difficulty"),
            joined(rest).alias("body"),
            rubric(rest, sheet.rubric, sheet.bullet, sheet.expected).alias("rubric"),
        )

    return F.transform(sessions(lines, places(F.transform(clean, lambda x: x.rlike(sheet.task) | x.rlike(sheet.question)))), block)


def _starts(line: Column, begins: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for b in begins:
        out = out | line.startswith(b)
    return out


def rubric(lines: Column, head: str, bullet: str, expected: str) -> Column:
    """array<struct<label, text>>: lines under each head, without their bullets and blank lines; those before the first head under the label ``expected``."""
    own = F.filter(F.transform(lines, cleaned), lambda x: x != "")
    heads = places(F.transform(own, lambda x: x.rlike(head)))
    plain = lambda part: F.array_join(F.transform(part, lambda x: F.regexp_replace(x, bullet + r"\s*", "")), "\n")
    first = between(own, F.lit(0), F.coalesce(F.get(heads, F.lit(0)), F.size(own)))
    before = F.when(F.size(first) > 0, F.array(F.struct(F.lit(expected).alias("label"), plain(first).alias("text")))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    return F.concat(before, F.transform(sessions(own, heads), lambda s: F.struct(F.regexp_extract(F.get(own, s["head"]), head, 1).alias("label"), plain(s["body"]).alias("text"))))


def numbered(text: Column, number: str = r"^(\d{1,2})\.$", grade: str = r"^(1[7-9]|2[01])\s*грейд\s*$", answer: str = "Ответ", skipped: tuple[str, ...] = ()) -> Column:
    """array<struct<number, title, condition, rubric>>: tasks of a document in which a line of nothing but a number opens each. Its title is the first line behind it; what stands before the first grade's head is the condition."""
    lines = F.filter(F.transform(lines_of(text), lambda x: F.rtrim(x)), lambda x: ~F.trim(x).isin("", *skipped))
    clean = F.transform(lines, F.trim)

    def task(s: Column) -> Column:
        body = s["body"]
        cut = first_place(body, lambda x: F.trim(x).rlike(grade))
        condition = F.filter(between(body, F.lit(1), cut), lambda x: F.trim(x) != answer)
        return F.struct(
            F.regexp_extract(F.get(clean, s["head"]), number, 1).try_cast("int").alias("number"),
            F.trim(F.coalesce(F.get(body, F.lit(0)), F.lit(""))).alias("title"),
            F.trim(F.array_join(condition, "\n")).alias("condition"),
            rubric(between(body, cut, F.size(body)), grade, r"^(?!x)x", "").alias("rubric"),
        )

    return F.transform(sessions(lines, places(F.transform(clean, lambda x: x.rlike(number)))), task)
