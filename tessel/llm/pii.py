"""Personal data by weak supervision.

Labelers of three families vote for or against candidate spans: regular expressions (the
shape), gazetteers (given names, places and months, suffixes, lengths by country) and contexts
(the cue nearest to the span, before or behind it), and a check of sums, ranges or invented
names. Expectation-maximisation estimates each labeler's reliability by kind from agreements,
leaning on what the labeler is by nature, and its posteriors train a logistic span classifier.

Both work on counts of distinct (kind, votes, shape) patterns over all spans of the corpus,
of which there are at most some ten thousand whatever its size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize

#: Kinds in output order; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "person", "iban", "national_id")
BASE = KINDS[:4]
#: Probability from which a span that is no base span, and for which shape, gazetteer or context speaks, is reported.
ACCEPT = 0.5
#: Characters before a span in which cue words count.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

# wider shapes, for candidates beyond the base patterns
_WIDE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![\w+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
}
def _plain(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


# fixed values: words that decide votes
_TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Sr Sra".split())
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
#: A run of capitalised words; only titles and initials have a full stop inside.
_CAPITALS = re.compile(rf"\b(?:(?:{'|'.join(sorted(_TITLES, reverse=True))})\.? )?{_CAPITAL}(?: (?:[A-ZÀ-ÖØ-Þ]\. )?{_CAPITAL})*")
#: Capitalised words that stand before a name and are no part of it.
_LEADS = frozenset("Dear Hello Hi The A An I My From By Signed Name Patient Contact Regards Sincerely Thanks Hallo Liebe Lieber Cher Chère Hola Estimado Estimada And But When Then With In On At For To Of This That Is Was Ask Call Meet".split())
_GIVEN = frozenset(
    "Adam Alan Albert Alexander Alice Amanda Amy Ana André Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Bernd Betty Brian Carl Carla Carlos Carmen Carol Caroline Catherine Charles Charlotte Chloé Chris Christian Christine Christopher Claire Claudia Claus Cristina Daniel David Deborah Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Erika Eva Felix Fernando Francisco Frank François Fritz Gabriel George Gerhard Grace Günter Hannah Hans Heinrich Helen Helga Henry Ingrid Isabel Jack Jacob Jacques James Jan Jane Javier Jean Jennifer Jessica Joan John Jonathan Jorge José Joseph Juan Julia Julie Jürgen Karen Karl Katharina Kevin Klaus Laura Lena Lisa Louis Lucía Luis Manuel Margaret María Marie Mark Markus Martha Martin Mary Matthew Michael Michel Monika Nancy Nicolas Nicole Olivia Otto Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Ralph Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Sofia Sophie Stefan Stephen Susan Sven Thomas Ursula Victor Walter William Wolfgang".split()
)
#: Months, days, places, institutions and the like: a run with one of them is no person.
_NO_NAMES = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Street Avenue Road Square Park Bridge River Lake Mount Mountain Island Bay Hill Valley City County State States Kingdom Republic Union Europe America Africa Asia North South East West New York London Paris Berlin Madrid Angeles Francisco University College School Institute Hospital Museum Library Church Company Bank Inc Corp Ltd Group Press Court Council Committee Ministry Department Office House Hall Station Airport Theatre League Cup Prize Award Day War World Act Law Windows Linux Google Python Spark".split()
)
#: Invented or proverbial bearers of a title or name.
_INVENTED = frozenset("Bean Dalloway House Who Watson Holmes Darcy Bennet Jekyll Hyde Frankenstein Strange Evil Spock Potter Bond Batman Doubtfire Robinson Pepper Fox Claus".split()) - _GIVEN

_SUFFIXES = frozenset("com org net edu gov io de fr es uk eu info at ch nl it be".split())
_COUNTRIES = frozenset(("1", "33", "34", "44", "49"))
#: Letters and digits of an account number by country.
_IBAN = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_CUES = {
    "email": r"e-?mail|contact|write|reach|courriel|correo|kontakt",
    "phone": r"phone|call|tel|mobile|fax|reach|anruf|appel|llam",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|pay|credit|karte|carte|tarjeta",
    "person": r"\bname\b|\bdear\b|contact|signed|patient|regards|sincerely|i am|i'm|my (?:friend|wife|husband|boss|doctor)|nombre|\bnom\b",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta",
    "national_id": r"\bssn\b|social|security|national id|taxpayer",
}
#: Cues against: what such digits and capitals mean elsewhere.
_NUMBERED = r"order|invoice|part|item|ref(?:erence)?\b|tracking|serial|model|isbn|issn|version|ticket|sku|catalog|article|lot\b|batch"
_AGAINST = {
    "email": r"variable|function|located|symbol|syntax",
    "phone": _NUMBERED,
    "ip": r"version|section|chapter",
    "card": _NUMBERED,
    "person": r"novel|film|movie|series|character|episode|starring|fiction|city of|battle of|university of|street|published by|company|\bband\b|\bmount\b",
    "iban": _NUMBERED + r"|code|licen[cs]e|product",
    "national_id": _NUMBERED,
}
_GIVEN_PLAIN = frozenset(_plain(w) for w in _GIVEN)
_NEAREST = {k: re.compile(f"({_CUES[k]})|({_AGAINST[k]})", re.I) for k in KINDS}
_BEHIND = re.compile(r"^,? (?:the (?:character|film|novel|series)|is (?:a|the) (?:film|novel|series|character|city|part)|Street|Avenue|Road|Inc|Ltd|Corp|University)", re.I)

#: What labelers are by nature: their rates of + on positives and on negatives. A check's rate on negatives is
#: the share of arbitrary digits that pass it; of titled names that are nobody's, four in ten are known inventions.
NATURE = {"shape": (0.9, 0.45), "gazetteer": (0.85, 0.2), "context": (0.9, 0.1)}
CHECKS = {"email": 0.5, "ip": 0.5, "card": 0.1, "phone": 0.64, "person": 0.6, "iban": 0.01, "national_id": 0.9}
#: Votes of each class for which nature counts: these, and this share of all that the labeler casts.
NATURE_VOTES, NATURE_SHARE = 20.0, 0.5


def nature_of(kind: str) -> np.ndarray:
    """Rates of the kind's labelers by nature, one row each: on positives, on negatives."""
    return np.array([*NATURE.values(), (0.99, CHECKS[kind])])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns, leftmost and non-overlapping per kind; invalid matches are dropped without retry.

    An e-mail's local part is the whole run before its "@" (or what a former match left of
    it), which is where a leftmost match starts; so long runs are read once.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if not _HINT.search(text):
        return found
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found["email"].append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _candidates(text: str, base: dict[str, list[tuple[int, int]]]):
    """(kind, start, end, is_base) of every span to vote on; wider shapes never overlap a base span of their kind."""
    for kind, spans in base.items():
        yield from ((kind, s, e, True) for s, e in spans)
    wide = []
    if "(at" in text or "[at" in text or "(AT" in text or "[AT" in text:
        wide.append("email")
    if _HINT.search(text):
        wide += ["phone", "national_id", "iban"]
    for kind in wide:
        held = base.get(kind, [])  # in order and disjoint, so only the last that starts before a match's end can meet it
        for m in _WIDE[kind].finditer(text):
            i = bisect_left(held, (m.end(),)) - 1
            if i < 0 or held[i][1] <= m.start():
                yield kind, *m.span(), False
    for m in _CAPITALS.finditer(text):
        start = m.start()
        words = m[0].split(" ")
        while words and words[0].rstrip(".") in _LEADS:
            start += len(words.pop(0)) + 1
        if len(words) > 1:
            yield "person", start, m.end(), False


def _nearest(kind: str, before: str, after: str) -> bool | None:
    """What the cue nearest to the span says; a cue behind the span goes before those in front."""
    if kind == "person" and _BEHIND.match(after):
        return False
    last = None
    for last in _NEAREST[kind].finditer(before):
        pass
    return None if last is None else last[1] is not None


def _votes(kind: str, span: str, before: str, after: str, is_base: bool) -> str:
    """One sign a labeler (shape, gazetteer, context, check): + for personal data, - against, 0 for no opinion."""
    shape: bool | None = True
    if kind == "email":
        known = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")] "))[-1].lower() in _SUFFIXES
        shape, check = is_base or None, None
    elif kind == "ip":
        # private and loopback ranges name no person
        known, check = span.split(".")[0] not in ("10", "127", "172", "192"), is_base
    elif kind == "card":
        known, check = span[0] in "3456", luhn(_digits(span))
    elif kind == "phone":
        if span[0] == "+":
            known, check = any(span.startswith("+" + c) for c in _COUNTRIES), 8 <= len(_digits(span)) <= 15
        else:  # areas and exchanges start at 2; 555-01.. is kept for fiction
            d = _digits(span)
            known, check = None, d[0] in "23456789" and d[3] in "23456789" and d[3:8] != "55501"
    elif kind == "person":
        words = [w for w in re.split(r"[ .]+", span) if w]
        titled = words[0] in _TITLES
        names = words[titled:]
        known = False if any(w in _NO_NAMES for w in names) else True if names and _plain(names[0]) in _GIVEN_PLAIN else None
        # capitals alone say little: a title or an initial speaks for a name, a long run against it
        shape = False if len(names) > 3 else titled or any(len(w) == 1 for w in names) or None
        check = not any(w in _INVENTED for w in names) or (len(names) > 1 and known is True)
    elif kind == "iban":
        size = _IBAN.get(span[:2])
        known, check = None if size is None else len(span.replace(" ", "")) == size, _mod97(span)
    else:
        area, group, serial = span.split("-")
        known, check = None, not (area in ("000", "666") or area >= "900" or group == "00" or serial == "0000")
    cue = _nearest(kind, before, after)
    if kind == "person" and cue is None and titled and check:
        cue = True  # its own title
    return "".join("0" if v is None else "+" if v else "-" for v in (shape, known, cue, check))


def _shape(text: str, start: int, end: int) -> str:
    """A small code of length and neighbours, for the classifier."""
    left, right = text[start - 1 : start], text[end : end + 1]
    side = lambda c: "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"
    return f"{min(end - start, 39) // 8}{side(left)}{side(right)}"


_FOUND = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, starts array<int>, ends array<int>, codes array<string>"


def _find(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(9)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            row = [doc, ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in base[k]), *[len(base[k]) for k in BASE], [], [], []]
            for kind, s, e, is_base in _candidates(text, base):
                row[6].append(s)
                row[7].append(e)
                row[8].append(f"{kind}|{_votes(kind, text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR], is_base)}|{_shape(text, s, e)}|{'b' if is_base else 'w'}")
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        types = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "base", "n_email", "n_ip", "n_card", "n_phone", "starts", "ends", "codes"])


def fit_reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, nature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of +1, -1, 0) weighted by counts.

    Returns the patterns' posteriors, each labeler's (hit rate on positives, on negatives)
    as P(votes + | class, it votes), and the share of positives. nature: the rates by which
    the labelers are known, which count for NATURE_VOTES votes of each class and NATURE_SHARE of
    the labeler's, so that they weigh alike in small and large corpora; without it they are
    better than chance and no more. Starts from the majority.
    """
    said, plus, w = votes != 0, votes > 0, counts.astype(float)
    post = np.clip(0.5 + votes.sum(axis=1) / (2 * np.maximum(said.sum(axis=1), 1)), 0.1, 0.9)
    rates, prior = np.empty((votes.shape[1], 2)), 0.5
    leaning = NATURE_VOTES + NATURE_SHARE * (w[:, None] * said).sum(axis=0)
    for _ in range(rounds):
        heard = w * said.any(axis=1)
        prior = float(np.clip(((heard * post).sum() + 1) / (heard.sum() + 2), 0.05, 0.95))
        for c, weight in ((0, w * post), (1, w * (1 - post))):
            # votes beforehand keep rates off 0 and 1
            known, of = ((2 if c == 0 else 1), 3) if nature is None else (nature[:, c] * leaning, leaning)
            rate = ((weight[:, None] * plus).sum(axis=0) + known) / ((weight[:, None] * said).sum(axis=0) + of)
            rates[:, c] = rate
        if nature is None:
            rates[:, 0], rates[:, 1] = np.maximum(rates[:, 0], 0.5), np.minimum(rates[:, 1], 0.5)
        else:  # a vote for is never a sign against
            rates[:, 0] = np.minimum(np.maximum(rates[:, 0], rates[:, 1] + 0.05), 0.999)
            rates[:, 1] = np.minimum(rates[:, 1], 0.9)
        like = [np.where(said, np.where(plus, rates[:, c], 1 - rates[:, c]), 1.0).prod(axis=1) for c in (0, 1)]
        post = prior * like[0] / (prior * like[0] + (1 - prior) * like[1])
    return post, rates, prior


def _features(codes: list[str]) -> np.ndarray:
    """One-hot kind, votes by kind, length, neighbours and the base flag of pattern codes."""
    rows = []
    for code in codes:
        kind, votes, shape, base = code.split("|")
        row = [kind == k for k in KINDS] + [kind == k and v == s for k in KINDS for v in votes for s in "+-"] + [shape[0] == c for c in "01234"] + [shape[i] == c for i in (1, 2) for c in "esap"] + [base == "b", True]
        rows.append(row)
    return np.array(rows, float).reshape(len(codes), -1)


def fit_span_classifier(codes: list[str], soft: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, weighted by the logarithm of counts; returns the codes' probabilities."""
    x = _features(codes)
    weight = np.log1p(counts.astype(float))
    weight /= max(weight.sum(), 1e-9)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= 4.0 * (x.T @ (weight * (p - soft)) + 1e-4 * beta)
    return 1 / (1 + np.exp(-x @ beta))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 cover the base patterns; spans adds what the span classifier
    accepts beyond them (other kinds follow the base ones). Offsets are code points. Null
    and empty texts have no spans; a corpus without candidates trains nothing. Repeated
    rows are reported each; columns but doc_id and text are ignored.
    """
    found = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, _FOUND), "spans")
    patterns = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    codes = sorted(r["code"] for r in patterns)
    sizes = {r["code"]: r["n"] for r in patterns}
    accepted: dict[str, float] = {}
    if codes:
        counts = np.array([sizes[c] for c in codes])
        votes = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in c.split("|")[1]] for c in codes])
        soft = np.empty(len(codes))
        of_kind = np.array([c.split("|")[0] for c in codes])
        for kind in KINDS:
            at = of_kind == kind
            if at.any():
                soft[at], _, _ = fit_reliabilities(votes[at], counts[at], nature=nature_of(kind))
        accepted = {c: float(p) for c, p in zip(codes, fit_span_classifier(codes, soft, counts), strict=True) if p >= ACCEPT and c.endswith("w") and "+" in c.split("|")[1][:3]}
    order = {k: i for i, k in enumerate(KINDS)}

    def report(batches):
        for batch in batches:
            data = batch.to_pydict()
            sha, spans, added = [], [], []
            for base, starts, ends, cs in zip(data["base"], data["starts"], data["ends"], data["codes"], strict=True):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                more = [(c.split("|")[0], s, e) for s, e, c in zip(starts, ends, cs, strict=True) if c in accepted]
                every = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)] + more
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in sorted(every, key=lambda x: (order[x[0]], x[1], x[2]))))
                added.append(len(more))
            kept = [batch.column(n) for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op3_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
