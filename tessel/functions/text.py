"""Text expressions: cleaning, references, coercion, validity, routing. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what decides results, as the engine's users know it ---

#: (pattern, what stays) of secrets in messages; the value becomes a mark.
SECRET_PATTERNS = (
    r"(?i)(api[_-]?key\s*[=:]\s*)[\"']?[\w-]{20,}[\"']?",
    r"(?i)(bearer\s+)[\w-]{20,}",
    r"(?i)(authorization\s*[=:]\s*)[\"']?[\w-]{20,}[\"']?",
    r"(?i)(MISTRAL_API_KEY\s*[=:]\s*)[\"']?[\w-]+[\"']?",
    r"(?i)(password\s*[=:]\s*)[\"']?[^\s\"']+[\"']?",
    r"(?i)(secret\s*[=:]\s*)[\"']?[\w-]+[\"']?",
    r"(?i)(token\s*[=:]\s*)[\"']?[\w-]{20,}[\"']?",
)
#: Keys of maps whose values are secret.
SECRET_KEYS = r"key|secret|token|password|passwd|pwd|auth|bearer"
#: Words that mark test content.
TEST_WORDS = ("test", "debug", "todo", "fixme", "xxx", "lorem ipsum", "example", "placeholder")
#: Connectors that make a question discursive.
CONNECTORS = ("et", "ou", "mais", "donc", "car", "parce que", "puisque", "si")
#: Words that carry no weight in routing.
STOP_WORDS = ("le", "la", "les", "un", "une", "des", "du", "de", "d", "ce", "cette", "ces", "mon", "ma", "mes", "ton", "ta", "tes", "à", "au", "aux", "dans", "sur", "pour", "par", "avec", "que", "qui", "quoi", "dont", "où", "est", "sont", "a", "qu", "c", "l", "s", "n", "m", "t", "j", "y")
#: Phrases in titles of sections that are not indexed.
EXCLUDED_TITLES = ("table des matières", "table des matieres", "sommaire", "table of contents", "contents", "toc", "index", "liste des figures", "liste des tableaux", "list of figures", "list of tables", "note de l'éditeur", "note de l'editeur", "note de la rédaction", "copyright", "mentions légales", "crédits", "colophon", "achevé d'imprimer")
#: Lines that look like section titles.
TITLE_LINE = r"(?i)^(?:comment\s+.+\?|où\s+.+|les?\s+[\p{L}\p{N}_]+\s+à\s+|que\s+.+\?|l[ae]\s+[\p{L}\p{N}_]+\s+(?:de|du)\s+|entre\s+.+\s+et\s+)"
#: Verbs of running prose, as whole words.
NARRATIVE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:est|sont|était|sera|a|ont|avait|avaient|fait|dit|pense|explique)(?:[^\p{L}\p{N}_]|$)"
#: Phrases that show reasoning.
REASONING_MARKERS = ("je pense que", "il me semble", "apres reflexion", "en analysant", "d'un point de vue", "cela suggere", "on pourrait dire", "il est probable que", "selon mon analyse", "en considerant", "je deduis que", "logiquement", "mon raisonnement", "je conclus", "en reflechissant")
#: Paragraph numbers at the start of a text, in order.
PARAGRAPH_PATTERNS = (r"^(\d+)\s+[A-ZÀ-Ü]", r"^(\d+)[A-ZÀ-Ü]", r"^§\s*(\d+)", r"^\[(\d+)\]", r"^(\d+)\.", r"^(\d+)\)")
#: Paragraph numbers of headings, with their letter.
HEADING_PATTERNS = (r"^(\d+[a-z]?)\.\s", r"^§\s*(\d+[a-z]?)\s", r"^CP\s+\d+\.(\d+)\.\s")
#: The reference at the start of a section path.
REFERENCE = r"^(?:§\s*)?(CP\s+[\d.]+|\d+[a-z]?)\.\s"


def trimmed(t: Column) -> Column:
    """t without any white space at its ends."""
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def without_page_marks(t: Column) -> Column:
    """t without page comments, with at most one blank line in a row, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"<!--\s*Page\s+\d+\s*-->", ""), r"\n{3,}", "\n\n"))


def without_ocr_noise(t: Column) -> Column:
    """t without lines of numbers or of three characters or fewer (headings stay), with single spaces."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~x.rlike(r"^\d{1,4}\s*$") & ((F.length(trimmed(x)) > 3) | x.startswith("#") | (trimmed(x) == "")))
    return trimmed(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_chunk(t: Column) -> Column:
    return without_ocr_noise(without_page_marks(t))


def without_markdown(t: Column) -> Column:
    """t as plain text: headings, emphasis, code, links, quotes, bullets and rules lose their marks."""
    for pattern, by in (
        (r"(?s)```.*?```", " "),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^>\s?", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^-{3,}$", ""),
        (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    return trimmed(t)


def shortened(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def markers(t: Column, wanted: tuple[str, ...]) -> Column:
    """Those of the wanted phrases that t holds, whatever their case."""
    return F.filter(F.array(*[F.lit(m) for m in wanted]), lambda m: F.contains(F.lower(t), m))


def canonical_reference(path: Column) -> Column:
    """The reference at the start of a section path, as "§128. " gives 128 and "CP 5.628. " CP 5.628; null without one."""
    return F.nullif(F.regexp_extract(path, REFERENCE, 1), F.lit(""))


def _first_of(t: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])


def paragraph_number(t: Column) -> Column:
    """The number of a paragraph such as "9 On", "10Dans", "§ 15", "[9]", "9." or "9)"."""
    return _first_of(t, PARAGRAPH_PATTERNS).try_cast("int")


def heading_number(t: Column) -> Column:
    """The number of a heading with its letter, as 628, 42 or 80a; null without one."""
    return _first_of(t, HEADING_PATTERNS)


def without_annotations(t: Column) -> Column:
    """t without a validator's remarks in brackets: any at the end, bare ones inside."""
    t = F.regexp_replace(t, r"(?i)\s*\([^)]*(?:correct|à confirmer|possiblement|probablement)[^)]*\)\s*$", "")
    return trimmed(F.regexp_replace(t, r"(?i)\s*\((?:correct|à confirmer)\)\s*", " "))


def roman(t: Column) -> Column:
    """A Roman numeral as an integer; unknown letters count 0."""
    value = lambda c: sum((F.when(c == k, v).otherwise(0) for k, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))), F.lit(0))
    letters = F.reverse(F.filter(F.split(F.upper(t), ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(letters, start, lambda a, c: F.struct(F.when(value(c) < a["last"], a["total"] - value(c)).otherwise(a["total"] + value(c)).alias("total"), value(c).alias("last")), lambda a: a["total"])


def json_block(t: Column) -> Column:
    """JSON inside a model's answer: a <JSON> block, else what the outermost braces hold, without control characters; null if neither."""
    block = F.regexp_extract(t, r"(?s)<JSON>\s*(.*?)\s*</JSON>", 1)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.nullif(F.regexp_replace(F.when(block != "", block).otherwise(braces), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit(""))


def json_list(t: Column, most: int = 5) -> Column:
    """The first strings of the first JSON array in t; an empty array if there is none."""
    got = F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\[.*?\]", 0), F.lit("")), "array<string>")
    return F.coalesce(F.slice(got, 1, most), F.array().cast("array<string>"))


def blank_to_null(t: Column) -> Column:
    """Null for blank and for the words null and None."""
    return F.when(~F.lower(trimmed(t)).isin("", "null", "none"), t)


def safe_int(t: Column, default: int = 0) -> Column:
    return F.coalesce(t.try_cast("int"), F.lit(default))


def safe_text(t: Column, default: str = "") -> Column:
    return F.coalesce(t.cast("string"), F.lit(default))


def relative_time(t: Column, now: Column) -> Column:
    """"7d", "3h", "1w" or "30m" (minutes) before now, or an ISO time; null if neither."""
    n = F.nullif(F.regexp_extract(t, r"^(\d{1,6})([dhwm])$", 1), F.lit("")).try_cast("int")
    unit = F.regexp_extract(t, r"^(\d{1,6})([dhwm])$", 2)
    days = F.when(unit == "d", n).when(unit == "w", n * 7).otherwise(0)
    back = F.make_dt_interval(days, F.when(unit == "h", n).otherwise(0), F.when(unit == "m", n).otherwise(0))
    return F.when(n.isNotNull(), now - back).otherwise(F.try_to_timestamp(t))


def redacted(t: Column, mark: str = "***REDACTED***") -> Column:
    for p in SECRET_PATTERNS:
        t = F.regexp_replace(t, p, "$1" + mark)
    return t


def redacted_map(m: Column, mark: str = "***REDACTED***") -> Column:
    """A string map with the values of secret-sounding keys replaced and the others redacted."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike(SECRET_KEYS), F.lit(mark)).otherwise(redacted(v, mark)))


def document_name(t: Column) -> Column:
    """A file name without its .pdf or .md."""
    return F.regexp_replace(t, r"(?i)\.(pdf|md)$", "")


def valid_chunk(t: Column, min_chars: int = 30, min_words: int = 5) -> Column:
    """Whether a chunk is worth indexing: long enough, and no address, date, ISBN, DOI or copyright line."""
    s = without_page_marks(t)
    return (F.length(s) >= min_chars) & (word_count(s) >= min_words) & ~s.rlike(r"(?i)^(?:https?://|\d{4}-\d{2}-\d{2}$|ISBN|DOI|©)")


def excluded_section(title: Column, content: Column, chapter: Column | None = None) -> Column:
    """Whether a section is front or back matter by its or its chapter's title, or a list of titles by the shape of its lines."""
    phrases = F.array(*[F.lit(x) for x in EXCLUDED_TITLES])
    named = lambda c: F.coalesce(F.exists(phrases, lambda x: F.contains(F.lower(trimmed(c)), x)), F.lit(False))
    lines = F.filter(F.transform(F.split(content, "\n"), trimmed), lambda x: x != "")
    n = F.size(lines)
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(n, F.lit(1))
    titles = F.size(F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(TITLE_LINE)))
    narrative = F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(NARRATIVE))
    listed = (n >= 5) & (mean < 50) & F.forall(F.slice(lines, 1, 10), lambda x: F.length(x) < 100) & ((titles >= n * 0.4) | ~narrative)
    return named(title) | (named(chapter) if chapter is not None else F.lit(False)) | F.coalesce(listed, F.lit(False))


def test_content(kind: Column, t: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))).isin("test", "debug", "example") | (F.length(F.coalesce(t, F.lit(""))) < 20) | F.exists(F.array(*[F.lit(x) for x in TEST_WORDS]), lambda x: F.contains(F.lower(t), x))


def usable_answer(role: Column, t: Column) -> Column:
    return (role == "assistant") & (F.length(t) >= 50) & ~t.startswith("[Error") & ~t.startswith("[System")


def needs_hierarchy(question: Column) -> Column:
    """Whether a question calls for two-stage search: long, with a connector, or two weighty words; blank ones don't."""
    q = F.lower(trimmed(F.coalesce(question, F.lit(""))))
    weighty = F.filter(F.split(q, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    connected = F.exists(F.array(*[F.lit(f" {c} ") for c in CONNECTORS]), lambda c: F.contains(padded, c))
    return (F.length(q) >= 15) | connected | (F.size(weighty) >= 2)


def errors(**checks: Column) -> Column:
    """The names of the checks that fail (a null check fails)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def numbered_prompt(passages: Column, question: Column, cut: int = 2000, most: int = 30_000) -> Column:
    """Numbered passages and a question; a prompt over `most` characters falls back to the first three passages."""
    def build(ps: Column) -> Column:
        listed = F.transform(ps, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), shortened(p, cut)))
        return F.concat(F.array_join(listed, "\n\n"), F.lit("\n\nQuestion: "), question)

    return F.when(F.length(build(passages)) > most, build(F.slice(passages, 1, 3))).otherwise(build(passages))
