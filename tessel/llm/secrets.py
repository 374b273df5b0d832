"""Secret scanning: a random forest removes the false positives of a wide pattern scan.

Candidates are described by their length, character transitions, dictionary coverage, path
and neighbouring words; the forest is trained on labelled findings. DataFrame and DataFrame
machine-learning operations only, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import let, materialize, table

#: A run of 16 or more token characters with a digit, read once from its start.
CORE = r"(?<![A-Za-z0-9+/_=~-])(?=[A-Za-z+/_=~-]*[0-9])[A-Za-z0-9+/_=~-]{16,}"
#: A whole run of 16 or more of these characters without a digit; a candidate behind a key's name or a provider's prefix.
LETTERS = r"(?<![A-Za-z0-9+/_=~-])[A-Za-z+/_=~-]{16,}(?![A-Za-z0-9+/_=~-])"
#: A key's name and the sign that assigns it.
KEY_NAME = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credential)s?[\"'`]?\s*(?:[=:]\s*[\"'`(]*|\s)"
#: A value of six or more characters assigned to a password.
ASSIGNED = r"(?i)(?:passw(?:or)?d|secret|pwd)[\"']?\s*[=:]\s*[\"']?\S{6,}"
PASSWORD_CUE = r"(?i)(?:passw(?:or)?d|secret|pwd)"
#: The name and sign before a password assigned within one word, and the whole assignment; a quoted value ends at its quote.
_NAMED = r"(?i)(?:passw(?:or)?d|secret|pwd)[\"']?[=:][\"'`]?"
WITHIN = r"(?i)(?:passw(?:or)?d|secret|pwd)[\"']?[=:](?:\"[^\"]{6,}|'[^']{6,}|`[^`]{6,}|[^\"'`].{5,})"
#: A name before the value of a run that is an assignment itself.
KEYED = r"^[A-Za-z][A-Za-z0-9_~-]*=(?=[^=])"

#: Words that secrets seldom hold, for dictionary coverage.
DICTIONARY = ("account", "address", "and", "auth", "base", "branch", "build", "change", "class", "client", "code", "com", "config", "content", "data", "date", "default", "demo", "document", "dummy", "error", "example", "fake", "false", "file", "foo", "format", "from", "header", "here", "html", "http", "image", "index", "info", "insert", "item", "json", "key", "label", "list", "local", "main", "message", "method", "model", "name", "none", "null", "number", "object", "page", "password", "path", "placeholder", "public", "redacted", "release", "replace", "report", "request", "response", "sample", "secret", "section", "server", "service", "source", "string", "system", "table", "test", "that", "the", "this", "time", "title", "token", "true", "type", "update", "user", "value", "version", "with", "your")
CUES = r"(?i)(?:token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|signing)"
BENIGN_CUES = r"(?i)(?:commit|sha\d*|md5|digest|checksum|hash|uuid|guid|etag|revision|build|version|order|invoice|isbn|image|href|src|file|path|class)"
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_|SG\.|hf_)"
TEST_PATH = r"(?i)(?:test|example|sample|mock|fixture|demo|docs?/|readme)"

#: Texts in which LETTERS may find a candidate.
LETTERED = KEY_NAME + r"[A-Za-z+/_=~-]{16,}|(?-i)(?<![A-Za-z0-9+/_=~-])(?:" + PREFIXES.removeprefix("^(?:") + r"[A-Za-z+/_=~-]{10,}"

#: A private key's whole block, which may run over many lines.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"

FEATURES = ("length", "digits", "upper", "distinct", "class_changes", "case_changes", "vowel_runs", "repeats", "hex", "uuid", "prefix", "key_block", "dictionary", "separators", "cue", "benign", "assigned", "quoted", "test_path", "after_word")

#: Findings the forest is trained on, trees, depth, seed.
TRAIN_ROWS, TREES, DEPTH, SEED = 6000, 40, 8, 17
#: Share of trees' votes from which a candidate is a secret.
ACCEPT = 0.5


def _placed(w: Column, pattern: str) -> Column:
    """All matches of pattern in w as structs (at, core), at counted from 1."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,core:string>>").alias("found"))

    def add(a: Column, core: Column) -> Column:
        # matches come in order and do not overlap, so each is the first of its text from there on
        return let(F.call_function("locate", core, w, a["next"]), lambda at: F.struct((at + F.length(core)).alias("next"), F.concat(a["found"], F.array(F.struct(at.alias("at"), core.alias("core")))).alias("found")))

    return F.aggregate(F.regexp_extract_all(w, F.lit(pattern), F.lit(0)), start, add, lambda a: a["found"])


def _values(found: Column, name: str, trim: str = "") -> Column:
    """Structs (at, core) with what `name` matches taken off the front of each, and `trim` off its end."""

    def value(c: Column) -> Column:
        rest = F.regexp_replace(c["core"], name, "")
        return F.struct((c["at"] + F.length(c["core"]) - F.length(rest)).alias("at"), (F.regexp_replace(rest, trim, "") if trim else rest).alias("core"))

    return F.transform(found, value)


def with_candidates(docs: DataFrame, path: str | None = "source", carry: Column | None = None) -> DataFrame:
    """(doc_id, word_no, core, before, after, path, carried) of every candidate of every whole text.

    word_no counts white-space separated words from 0. A word gives every run that CORE
    finds in it, those without a digit that LETTERS finds behind a key's name or with a
    provider's prefix, the value of a run that is an assignment, and each password that is assigned
    in it or before it; a private key's block over several lines is a candidate as a whole,
    at its first word. Null and empty texts have none. path names the column that says where
    a document comes from; missing or null is empty.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    rows = rows.where(F.col("text").rlike(CORE) | F.col("text").rlike(ASSIGNED) | F.col("text").rlike(LETTERED) | F.col("text").contains("-----BEGIN "))
    place = lambda at: (F.size(F.split(F.substring("text", F.lit(1), at), r"\s+")) - 1).cast("long")
    lead = lambda at: F.substring("text", F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40)))
    blocks = F.transform(_placed(F.col("text"), KEY_BLOCK), lambda c: F.struct(place(c["at"]).alias("word_no"), c["core"].alias("core"), lead(c["at"]).alias("before"), F.lit("").alias("after")))
    blocks = F.when(F.col("text").contains("-----BEGIN "), blocks).otherwise(F.array().cast("array<struct<word_no:bigint,core:string,before:string,after:string>>"))
    rows = rows.select("doc_id", "path", "carried", blocks.alias("blocks"), F.split("text", r"\s+").alias("words"))
    near = lambda i: F.concat_ws(" ", *[F.get("words", i - k) for k in (3, 2, 1)])
    none = F.array().cast("array<struct<at:int,core:string>>")

    def look(w: Column, i: Column) -> Column:
        # the slashes of an address are not its value's
        runs = let(_values(_placed(w, CORE), "^//+"), lambda f: F.concat(f, F.filter(_values(F.filter(f, lambda c: c["core"].rlike(KEYED)), KEYED), lambda c: c["core"].rlike(CORE))))
        lead = lambda c: F.concat_ws(" ", near(i), F.substring(w, F.lit(1), c["at"] - 1))
        bare = let(_placed(w, LETTERS), lambda f: F.concat(f, _values(F.filter(f, lambda c: c["core"].rlike(KEYED)), KEYED)))
        bare = F.filter(bare, lambda c: (F.length(c["core"]) >= 16) & (c["core"].rlike(PREFIXES) | lead(c).rlike(KEY_NAME + "$")))
        inside = _values(_placed(w, WITHIN), "^" + _NAMED, r"[\"'`,;.)\]}]+$")
        password = (F.length(w) >= 6) & F.get("words", i - 1).rlike(r"[=:][\"']?$") & near(i).rlike(PASSWORD_CUE)
        whole = let(F.regexp_replace(w, r"^[\"'`(]+|[\"'`,;.)]+$", ""), lambda core: F.array(F.struct(F.call_function("locate", core, w).alias("at"), core.alias("core"))))
        found = F.concat(F.when(w.rlike(CORE), runs).otherwise(none), F.when(w.rlike(LETTERS), bare).otherwise(none), F.when(w.rlike(WITHIN), inside).otherwise(none), F.when(password, whole).otherwise(none))
        found = F.filter(F.array_distinct(found), lambda c: F.length(c["core"]) >= 6)
        return F.transform(found, lambda c: F.struct(i.cast("long").alias("word_no"), c["core"].alias("core"), F.concat_ws(" ", near(i), F.substring(w, F.lit(1), c["at"] - 1)).alias("before"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("after")))

    found = F.concat(F.flatten(F.transform("words", look)), F.col("blocks"))
    return rows.select("doc_id", "path", "carried", F.explode(found).alias("c")).select("doc_id", "c.word_no", "c.core", "c.before", "c.after", "path", "carried")


def with_features(rows: DataFrame) -> DataFrame:
    """rows (core, before, after, path) with the forest's features as columns."""
    core, size = F.col("core"), F.greatest(F.length("core"), F.lit(1))
    count = lambda pattern: F.regexp_count(core, F.lit(pattern)).cast("double")
    covered = size - F.length(F.regexp_replace(F.lower(core), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    flag = lambda c: c.cast("double")
    values = {
        "length": flag(F.least(size, F.lit(200))),
        "digits": count("[0-9]") / size,
        "upper": count("[A-Z]") / size,
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / F.least(size, F.lit(64)),
        "class_changes": count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / size,
        "case_changes": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "vowel_runs": count("[^aeiouAEIOU0-9][aeiouAEIOU](?=[^aeiouAEIOU0-9])") / size,
        "repeats": count(r"(.)\1") / size,
        "hex": flag(core.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(core.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "prefix": flag(core.rlike(PREFIXES)),
        "key_block": flag(core.rlike("^" + KEY_BLOCK)),
        "dictionary": covered / size,
        "separators": count("[-_/.=~]") / size,
        "cue": flag(F.col("before").rlike(CUES)),
        "benign": flag(F.col("before").rlike(BENIGN_CUES)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`(]*\s*$")),
        "quoted": flag(F.col("before").rlike(r"[\"'`]$")),
        "test_path": flag(F.col("path").rlike(TEST_PATH)),
        "after_word": flag(F.col("after").rlike(r"^[A-Za-z]")),
    }
    return rows.select("*", *[values[f].cast("double").alias(f"f_{f}") for f in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """Findings (core, before, after, path, label) with known answers, made from hashes of their numbers.

    Half are secrets: provider-shaped keys, random hexadecimal, base64 or alphanumeric
    values behind a cue, key blocks and passwords. The others are what such scans wrongly
    report: digests and identifiers behind their own cues, placeholders, names, paths,
    numbers. What a value is decides its label; its surroundings do not: of the shaped keys
    and blocks every second stands behind plain words, and of the harmless kinds that show
    what they are (names, placeholders, numbers, identifiers) every third behind a secret's cue.
    Paths are drawn without regard to the label. A fourth of the keys and of the base64
    values, and a third of the names, have letters alone; some of those names are made of
    syllables, which no dictionary lists.
    """
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    pick = lambda k, options: F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(draw(k), F.lit(len(options))).cast("int") + 1)
    many = lambda k, n: F.concat(*[F.sha2(F.concat(F.lit(f"{seed}-{k}-{j}-"), F.col("id").cast("string")), 256) for j in range(n)])
    hexa = lambda k, n: F.substring(many(k, 2), 1, n)
    b64 = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(many(k, 2))), "[^A-Za-z0-9+/]", ""), 1, n)
    alnum = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(many(k, 2))), "[^A-Za-z0-9]", ""), 1, n)
    year = lambda k: (F.pmod(draw(k), F.lit(40)) + 1990).cast("string")
    name = lambda k: F.concat(pick(f"{k}a", DICTIONARY[:40]), pick(f"{k}s", ["_", "-", "/", ""]), pick(f"{k}b", DICTIONARY[40:]), pick(f"{k}t", ["_", "-", "/", ""]), pick(f"{k}c", DICTIONARY[20:60]))
    cue = F.concat(pick("w", ["the", "set", "export", "of", "and", "with"]), F.lit(" "), pick("c", ["token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "client_secret"]), pick("o", [" = \"", "=", ": ", "=\"", " = '", ": \"", " = "]))
    plain = F.concat(pick("w", ["the", "see", "from", "in", "at", "on"]), F.lit(" "), pick("p", ["commit ", "sha256: ", "uuid=", "file ", "path=", "version ", "build ", "image ", "order ", "the ", "and ", "id: ", "checksum "]))
    syllables = ("ba", "con", "ter", "mi", "lo", "sta", "ren", "da", "vel", "po", "sin", "tra", "me", "fal", "go", "nu")
    invented = F.concat_ws("_", *[F.concat(*[pick(f"i{g}{n}", syllables) for n in range(4)]) for g in range(2)])
    kind = F.pmod(draw("kind"), F.lit(15))
    lettered = F.pmod(draw("lettered"), F.lit(12))
    core = (
        F.when(kind == 0, F.concat(pick("x", ["AKIA", "ASIA"]), F.upper(alnum("a", 16))))
        .when(kind == 1, F.concat(pick("x", ["ghp_", "gho_", "ghs_"]), alnum("a", 36)))
        .when(kind == 2, F.concat(pick("x", ["sk-", "sk_live_", "xoxb-", "AIza", "hf_", "glpat-"]), alnum("a", 32)))
        .when(kind.isin(3, 4), F.when(F.pmod(draw("n"), F.lit(3)) == 0, hexa("h", 32)).when(F.pmod(draw("n"), F.lit(3)) == 1, hexa("h", 40)).otherwise(hexa("h", 64)))
        .when(kind == 5, b64("b", 40))
        .when(kind == 6, F.concat(alnum("p", 7), pick("q", ["9", "7x", "_4", "2024"])))
        .when(kind == 7, F.concat_ws("-", hexa("u", 8), hexa("v", 4), hexa("w", 4), hexa("x", 4), hexa("y", 12)))
        .when(kind.isin(8, 9), F.when(F.pmod(draw("n"), F.lit(2)) == 0, hexa("h", 40)).otherwise(hexa("h", 64)))
        .when(kind == 10, F.concat(name("n"), pick("s", ["-", "_"]), year("y")))
        .when(kind == 11, F.concat(pick("x", ["your_", "example-", "INSERT_", "xxxx"]), pick("z", ["api_key_here_", "token-placeholder-", "secret_value_"]), F.pmod(draw("d"), F.lit(1000)).cast("string")))
        .when(kind == 12, F.concat(F.pmod(draw("d"), F.lit(10**9)).cast("string"), F.pmod(draw("e"), F.lit(10**9)).cast("string")))
        .when(kind == 13, F.concat(name("n"), F.lit("/"), name("m"), F.lit("2")))
        .otherwise(F.concat(F.lit("-----BEGIN "), pick("x", ["RSA ", "EC ", ""]), F.lit("PRIVATE KEY-----\n"), b64("a", 60), F.lit("\n"), b64("c", 60), F.lit("\n-----END RSA PRIVATE KEY-----")))
    )
    core = let(core, lambda c: F.when(kind.isin(0, 1, 2, 5) & (F.pmod(lettered, F.lit(4)) == 0), F.translate(c, "0123456789", "gKmQrTvWyZ"))
        .when(kind.isin(10, 13) & (F.pmod(lettered, F.lit(6)) == 0), invented)
        .when(kind.isin(10, 11, 13) & (F.pmod(lettered, F.lit(3)) == 0), F.regexp_replace(c, "[-_/]?[0-9]+", ""))
        .otherwise(c))
    secret = (kind <= 6) | (kind == 14)
    label = secret.cast("double")
    turn = lambda n: F.pmod(draw("turn"), F.lit(n)) == 0
    shaped, plainly = kind.isin(0, 1, 2, 14), kind.isin(7, 10, 11, 12, 13)
    secret_like = F.when(shaped, turn(2)).when(plainly, (kind == 11) | turn(3)).otherwise(secret)
    rows_ = spark.range(rows, numPartitions=2).select(
        core.alias("core"),
        F.when(secret_like, cue).otherwise(plain).alias("before"),
        pick("after", ["", "the", "and", ";", "#", "of", "that"]).alias("after"),
        F.when(F.pmod(draw("path"), F.lit(4)) == 0, pick("pf", ["src/app/settings.py", "tests/fixtures/sample.json", "docs/readme.md", "deploy/prod.env"])).otherwise(F.concat(F.lit("src"), F.pmod(draw("pp"), F.lit(20)).cast("string"))).alias("path"),
        label.alias("label"),
    )
    return rows_


def fit_forest(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings (core, before, after, path, label); callers bound their number."""
    rows = materialize(with_features(findings).select("label", *[f"f_{f}" for f in FEATURES]), "findings")
    packed = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features", handleInvalid="keep").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(packed.select("label", "features"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = "source", carry: Column | None = None) -> DataFrame:
    """One row per candidate of docs: doc_id, word_no, core, probability, is_secret.

    Without findings the forest is trained on labelled_findings(). Repeated rows repeat
    their candidates; empty tables and texts without candidates give no rows. Columns but
    doc_id, text and the path column are ignored.
    """
    forest = fit_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = with_features(with_candidates(docs, path, carry))
    packed = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features", handleInvalid="keep").transform(rows)
    scored = forest.transform(packed).select("doc_id", "word_no", "core", F.round(vector_to_array("probability")[1], 9).alias("probability"), *([] if carry is None else ["carried"]))
    return scored.withColumn("is_secret", F.col("probability") >= ACCEPT)


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """text with every string of the array `secrets` replaced, the longest first."""
    longest = F.reverse(F.array_sort(F.transform(secrets, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    return F.aggregate(longest, text, lambda t, s: F.replace(t, s["s"], F.lit(mark)))


def op8_random_forest(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", F.length("core").cast("long").alias("length"), F.sha2("core", 256).alias("core_sha256"), "probability", "is_secret")
