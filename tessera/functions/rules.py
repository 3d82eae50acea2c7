"""Quality rules of cards and prompts as column expressions: one flag a code, gathered in the order of the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants

# Fixed values of the rules.
HEADINGS = ("c", "sql", "-", ".", ":", ";", "указатели", "jquery", "deepcopy")
TRAILING_WORDS = (
    "для", "у", "нас", "в", "во", "на", "с", "со", "к", "ко", "по", "из", "от", "до", "без", "над", "под", "при", "об", "о",
    "который", "которая", "которое", "которые", "если", "когда", "чтобы", "for", "to", "with", "and", "or", "that", "which", "if", "when",
)
TRAILING_PHRASE = " у нас"
TASK_KINDS = ("discussion_prompt", "design_exercise", "runtime_task_reference", "historical_content")
SEMANTIC_SHAPE = (
    "empty_prompt", "prompt_equals_answer", "prompt_matches_title", "prompt_matches_topic", "pdf_heading_prompt", "placeholder_title",
    "code_fragment_title", "single_token_prompt", "short_label_prompt", "fragment_prompt",
)
TEST_MARKS = ("fixture", "smoke", "synthetic", "test")
#: soft hyphen, zero-width marks, word joiner, replacement character, and controls other than tab, line feed and carriage return
ARTIFACT = r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
TASK_FAMILY = r"^task-family\.[a-z0-9][a-z0-9-]*$"


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fields(c: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def comparable(c: Column) -> Column:
    return F.lower(F.array_join(fields(c), " "))


def asks(c: Column) -> Column:
    return c.rlike("[?？]")


def has_artifact(c: Column) -> Column:
    return F.coalesce(c.rlike(ARTIFACT), F.lit(False))


def bound(value: Column, body) -> Column:
    """body(value), with ``value`` made once a row: an expression that several branches of a condition use is otherwise made in each."""
    return F.transform(F.array(value), body)[0]


def is_heading(c: Column) -> Column:
    """Blank, ends in a dash, is punctuation alone, or is one of the known headings."""
    return heading_like(comparable(c))


def heading_like(v: Column) -> Column:
    """As is_heading() of what comparable() gave."""
    return (v == "") | v.endswith("—") | v.rlike("^[ .,:;—-]+$") | v.isin(*HEADINGS)


def is_code_fragment(c: Column) -> Column:
    v = trimmed(F.coalesce(c, F.lit("")))
    return v.contains(":=") | v.contains("map[") | (v.contains("func ") & v.contains("(")) | (v.rlike("[{}]") & v.contains("="))


def is_fragment(c: Column) -> Column:
    """The prompt ends like half a sentence."""
    v = trimmed(F.coalesce(c, F.lit("")))
    return cut_off(v, fields(v), asks(v))


def cut_off(v: Column, words: Column, question: Column) -> Column:
    """As is_fragment() of a trimmed text, its words, and whether it asks."""
    last = F.regexp_replace(F.lower(F.try_element_at(words, F.lit(-1))), r"^[ \t\r\n.,!?;:()\[\]{}\"'«»`]+|[ \t\r\n.,!?;:()\[\]{}\"'«»`]+$", "")
    cut = (F.size(words) >= 2) & ~v.rlike("[.!?。！？]$") & (last.isin(*TRAILING_WORDS) | F.lower(v).endswith(TRAILING_PHRASE))
    return (v != "") & ~question & (v.rlike("[,:;—-]$") | F.coalesce(cut, F.lit(False)))


def gathered(rules: list[tuple[Column, str]]) -> Column:
    """The codes of the rules that hold, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules])))


def prompt_codes(prompt: Column, answer: Column, title: Column, topic: Column) -> Column:
    """Codes of one locale; an empty prompt has that code alone."""

    def codes(x: Column, v: Column) -> Column:
        p, words, question = x["p"], x["words"], x["asks"]
        same = lambda other: (x[other] != "") & (v == x[other])
        n = F.size(words)
        label, bare = (n <= 2) & ~question, ~question & ~x["marks"]
        return gathered([
            (same("answer"), "prompt_equals_answer"),
            (same("title") & label, "prompt_matches_title"),
            (same("topic") & label, "prompt_matches_topic"),
            (heading_like(v), "pdf_heading_prompt"),
            (has_artifact(p), "pdf_artifact"),
            (cut_off(p, words, question), "fragment_prompt"),
            ((n == 1) & bare, "single_token_prompt"),
            ((n == 2) & (F.length(p) < 20) & bare, "short_label_prompt"),
        ])

    others = [comparable(c).alias(name) for c, name in ((answer, "answer"), (title, "title"), (topic, "topic"))]
    made = lambda p: F.struct(p.alias("p"), fields(p).alias("words"), asks(p).alias("asks"), p.rlike(r"[\p{P}\p{S}]").alias("marks"), *others)
    rest = lambda p: bound(made(p), lambda x: bound(F.lower(F.array_join(x["words"], " ")), lambda v: codes(x, v)))
    return bound(trimmed(F.coalesce(prompt, F.lit(""))), lambda p: F.when(p == "", F.array(F.lit("empty_prompt"))).otherwise(rest(p)))


@dataclass(frozen=True)
class Layout:
    """What the sheets of one scope leave in extracted text: labels are whole lines, parts are found anywhere in one, starts at its begin; all in lower case."""

    scope: str
    labels: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()


def is_layout_line(line: Column, layout: Layout) -> Column:
    own, v = trimmed(line), comparable(line)
    out = own.startswith("GO ") | (own == "GO") | own.startswith(": :") | v.rlike("^[0-9]+/[0-9]+$") | v.isin(*layout.labels)
    for part in layout.parts:
        out = out | v.contains(part)
    for start in layout.starts:
        out = out | v.startswith(start)
    return out


def has_layout_artifact(scope: Column, text: Column, layout: Layout | None) -> Column:
    """Footers and sidebar marks of one scope's extracted sheets; authored text elsewhere may hold the same words. Without a layout there are none."""
    if layout is None:
        return F.lit(False)
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n")
    return F.coalesce(F.lower(trimmed(scope)) == layout.scope, F.lit(False)) & F.exists(lines, lambda line: is_layout_line(line, layout))


def title_codes(title: Column) -> Column:
    return gathered([(is_heading(title), "placeholder_title"), (is_code_fragment(title), "code_fragment_title")])


def card_codes(title: Column, topic: Column, scope: Column, en: tuple[Column, Column], ru: tuple[Column, Column], sections: Column, payload: Column, layout: Layout | None = None) -> Column:
    """The gate of a card. en, ru: prompt and answer; sections: array<struct<title, body>>; payload: JSON text or null. The first section that fails decides which of its two codes is given."""
    none = F.array().cast("array<string>")
    bad = F.filter(sections, lambda s: has_artifact(s["title"]) | has_artifact(s["body"]) | has_layout_artifact(scope, s["body"], layout))
    first = F.try_element_at(bad, F.lit(1))
    section = F.when(F.size(bad) > 0, F.array(F.when(has_artifact(first["title"]) | has_artifact(first["body"]), F.lit("pdf_artifact")).otherwise("pdf_layout_artifact"))).otherwise(none)
    strings = variants.strings(payload)
    parts = F.array(*[F.get_json_object(payload, f"$.{k}") for k in ("question", "sections", "task", "rubric", "choices")])
    told = F.flatten(F.transform(F.array_compact(parts), lambda p: F.when(p.rlike(r"^\s*[\[{]"), variants.strings(p)).otherwise(F.array(p))))
    whole = gathered([(F.exists(strings, has_artifact), "pdf_artifact"), (F.exists(told, lambda s: has_layout_artifact(scope, s, layout)), "pdf_layout_artifact")])
    russian = F.when(~blank(ru[0]) | ~blank(ru[1]), prompt_codes(*ru, title, topic)).otherwise(none)
    return F.array_distinct(F.concat(title_codes(title), prompt_codes(*en, title, topic), russian, section, F.coalesce(whole, none)))


def semantic_shape(codes: Column) -> Column:
    return F.filter(codes, lambda c: c.isin(*SEMANTIC_SHAPE))


def task_codes(version: Column, kind: Column, family: Column, solution: Column, contract: str = "task-brief.v1") -> Column:
    """The boundary of versioned tasks; a task without a contract version is a historical one and passes."""
    family = trimmed(F.coalesce(family, F.lit("")))
    reference = F.coalesce(kind == "runtime_task_reference", F.lit(False))
    rules = [
        (version != contract, "task_contract_version"),
        (~F.coalesce(trimmed(kind).isin(*TASK_KINDS), F.lit(False)), "task_kind"),
        ((family != "") & ~family.rlike(TASK_FAMILY), "task_family_key"),
        (reference & (family == ""), "task_family_required"),
        (~reference & (family != ""), "task_family_unexpected"),
        (~blank(solution), "task_solution_forbidden"),
    ]
    return F.when(blank(version), F.array().cast("array<string>")).otherwise(gathered(rules))


def degenerate(prompt: Column, answer: Column) -> Column:
    """A locale whose prompt is blank or its own answer."""
    return blank(prompt) | F.coalesce(trimmed(prompt) == trimmed(answer), F.lit(False))


def from_test(c: Column) -> Column:
    """Provenance that names a test."""
    return F.coalesce(F.lower(c).rlike("|".join(TEST_MARKS)), F.lit(False))


def has_cyrillic(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{IsCyrillic}"), F.lit(False))


def translation_problems(source: list[Column], translated: list[Column]) -> Column:
    """Numbers of the fields whose translation is missing or has no Cyrillic letter although the source has text."""
    return F.array_compact(F.array(*[F.when(~blank(s) & (blank(t) | ~has_cyrillic(t)), F.lit(i)) for i, (s, t) in enumerate(zip(source, translated, strict=True))]))


def bounded_identity(c: Column, limit: int = 79) -> Column:
    """Lower-case letters, digits, dots, underscores and dashes, ``limit`` at most."""
    return F.substring(F.regexp_replace(F.lower(trimmed(c)), r"[^a-z0-9._-]+", "-"), 1, limit)


def similar_titles(a: Column, b: Column, n: int = 38) -> Column:
    """Either title begins as the first ``n`` characters of the other."""
    x, y = comparable(a), comparable(b)
    return (x != "") & (y != "") & (x.startswith(F.substring(y, 1, n)) | y.startswith(F.substring(x, 1, n)))


def normal_text(c: Column) -> Column:
    """Line ends of one kind, no blanks at the ends of lines or around the text."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"(?m)[ \t]+$", ""))


# Accented Latin letters and their plain ones, place by place: fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝøØ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYoO"


def unaccent(c: Column) -> Column:
    spelled = F.translate(c, ACCENTED, PLAIN)
    for letter, two in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        spelled = F.replace(spelled, F.lit(letter), F.lit(two))
    return spelled


# Words in section titles that tell a learning layer; the first layer of the list that fits takes the section: fixed values.
LAYERS = (
    ("follow_ups", ("follow-up", "follow up")),
    ("traps", ("trap", "common mistake", "pitfall", "edge case")),
    ("terms", ("must-say", "must say", "term", "terminology", "vocabulary")),
    ("practice", ("practice", "drill", "code example", "exercise", "task", "walkthrough")),
    ("mechanism", ("go deeper", "deep dive", "mechanism", "core idea", "explanation")),
)


def meaningful(json: Column) -> Column:
    """A JSON value, as text, that is not null, blank, or an empty list or object."""
    return F.coalesce(~json.rlike(r'^\s*(null|""|\[\s*\]|\{\s*\}|)\s*$') & (trimmed(json) != ""), F.lit(False))


def learning_layers(payload: Column, locales: Column, answer: Column, explanation: Column) -> Column:
    """Struct of the nine flags: short_answer, mechanism, russian_layer, task, practice, follow_ups, traps, terms, project_evidence."""
    sections = F.coalesce(F.from_json(F.get_json_object(payload, "$.sections"), "array<struct<title: string, body: string>>"), F.array().cast("array<struct<title: string, body: string>>"))
    titles = F.transform(F.filter(sections, lambda s: s.isNotNull() & meaningful(s["body"])), lambda s: comparable(s["title"]))
    holds = lambda t, terms: F.lit(False) if not terms else F.coalesce(t.rlike("|".join(terms)), F.lit(False))

    def layer_of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, terms in reversed(LAYERS):
            out = F.when(holds(t, terms), F.lit(name)).otherwise(out)
        return out

    found = F.transform(titles, layer_of)
    key = lambda k: meaningful(F.get_json_object(payload, f"$.{k}"))
    has = lambda k: F.coalesce(F.array_contains(found, k), F.lit(False))
    return F.struct(
        (~blank(answer)).alias("short_answer"),
        (~blank(explanation) | has("mechanism")).alias("mechanism"),
        F.exists(locales, lambda x: F.lower(trimmed(x)) == "ru").alias("russian_layer"),
        key("task").alias("task"),
        *[(key(k) | has(k)).alias(k) for k in ("practice", "follow_ups", "traps", "terms")],
        (key("project_evidence") | F.exists(titles, lambda t: t.contains("project evidence"))).alias("project_evidence"),
    )
