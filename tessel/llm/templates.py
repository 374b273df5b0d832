"""Main text of web pages by equivalence-class template deduction.

Tokens are a page's elements, named by their path of tags (boxes of one kind in one parent
by their number too), and the words between two tags.
Tokens of a host that occur equally often on each of its pages (equal occurrence vectors)
form a class. A class is valid if its elements stand once a page and either follow the same
element on all of them or are two at least; valid classes nest, by the elements that hold
them, into the host's template. Its slots are what those elements hold beside words that are
the same on every page. From the root, the slot that holds most of the varying unlinked text
is followed down to the article. Names of elements mark what lies inside or beside it; where
the article itself has such a name, the template overrules it. Names decide alone where a
host shows no template.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import BROADCAST_LIMIT, materialize, mix64, small_enough, table

#: Copies of a template in the shuffled join, over which a host's pages are spread.
SALTS = 64
#: Share of its surroundings' varying text from which a slot is followed.
FOLLOW = 0.6
#: The same, for a slot to overrule its own name although an element with an article's name varies too.
FIRM = 0.9
#: Share of a slot's characters inside links from which it is navigation.
LINKS = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)?|=)*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same group closes.
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}
_SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote".split())

_DROP_TAGS = frozenset("head nav footer aside form button select dialog menu object audio video canvas fieldset".split())
_DROP_NAMES = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|sidebar|side-bar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|topbar|toolbar|comment|comments|reply|replies|disqus|discussion|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|widget|copyright)(?=$|[-_ \ds])", re.I)
_COMMENTS = re.compile("comment|repl|disqus|discussion", re.I)
_MAIN = frozenset(("article", "main"))
_MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|articlebody|main|content|entry|post|story)(?:$|[-_ ])", re.I)


_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre figcaption".split())


def _label(name: str, attrs: str) -> str:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if "=" in attrs else ""
    return f"{name}.{names}" if names else name


def _child(parent: int, label: str) -> int:
    """The path id of a child element: a hash of its parent's and its label."""
    x = (parent ^ zlib.crc32(label.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0x7FFFFFFFFFFFFFFF


def parse(page: str | None):
    """(elements, nodes) of a page.

    elements: (path id, index of the parent or -1, label) in page order. nodes: (element's
    index or -1, text, whether linked, whether a new block) of the text in order. Unclosed
    elements end where HTML ends them; comments, scripts and styles give neither. Elements
    may be nested to any depth, attributes quoted or not.
    """
    nodes: list[tuple[int, str, bool, bool]] = []
    elements: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []  # name, index
    opened: Counter = Counter()
    nth: Counter = Counter()
    links, fresh, at = 0, True, 0
    page = page or ""

    def text(upto: int) -> None:
        nonlocal fresh
        if upto > at and (raw := page[at:upto]) and not raw.isspace():
            nodes.append((stack[-1][1] if stack else -1, raw, links > 0, fresh))
            fresh = False
        elif upto > at and nodes and not fresh:
            nodes.append((nodes[-1][0], " ", links > 0, False))

    def pop(to: int) -> None:
        nonlocal links
        for name, _ in stack[to:]:
            opened[name] -= 1
            links -= name == "a"
        del stack[to:]

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name == "br" and nodes and not fresh:
            nodes.append((nodes[-1][0], " ", links > 0, False))
        if name not in _INLINE:
            fresh = True
        if m[2]:
            if opened[name]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name not in _INLINE and name not in _VOID:
            ends = _CLOSES.get(name, frozenset()) | {"p"}
            if any(opened[e] for e in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        pop(i)
                    elif stack[i][0] in _SCOPES:
                        break
        label, parent = _label(name, m[4]), stack[-1][1] if stack else -1
        nth[parent, label] += name not in _INLINE and name not in _BLOCKS
        elements.append((_child(elements[parent][0] if parent >= 0 else 0, f"{label}/{nth[parent, label]}"), parent, label))
        if name not in _VOID and not m[4].endswith("/"):
            stack.append((name, len(elements) - 1))
            opened[name] += 1
            links += name == "a"
    text(len(page))
    return elements, nodes


def host_of(url: Column) -> Column:
    """The URL's host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


_TOKENS = "host string, path long, parent long, label string, times long, vector long, before long, chars long, linked long, said long"


def _count_tokens(batches):
    """One row per page and token: how often, a hash of (page, occurrences), the element before, characters, linked ones, and a hash of its text.

    An element's text is what stands directly in it; words between tags have a null label.
    """
    for batch in batches:
        rows: list[tuple] = []
        for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            elements, nodes = parse(page)
            times = Counter(e[0] for e in elements)
            info: dict[int, tuple[int, str]] = {}
            before: dict[int, int] = {}
            last = 0
            for path, parent, label in elements:
                if path not in info:
                    info[path] = (elements[parent][0] if parent >= 0 else 0, label)
                    if times[path] == 1:
                        before[path], last = last, path
            chars: Counter = Counter()
            linked: Counter = Counter()
            said: dict[int, int] = defaultdict(int)
            words: Counter = Counter()
            for element, text, link, _ in nodes:
                path, n = elements[element][0] if element >= 0 else 0, len(text)
                chars[path] += n
                linked[path] += n * link
                said[path] = zlib.crc32(text.encode("utf-8", "replace"), said[path])
                if not text.isspace():
                    words[path, zlib.crc32(text.encode("utf-8", "replace")), n] += 1
            rows += [(host, p, info[p][0], info[p][1], n, key ^ n * 0x9E3779B97F4A7C15, before.get(p, 0), chars[p], linked[p], said[p]) for p, n in times.items()]
            rows += [(host, _child(p, f"={crc}"), p, None, n, key ^ n * 0x9E3779B97F4A7C15, 0, size * n, 0, 0) for (p, crc, size), n in words.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 10
        # sums of the vector's hashes tell vectors apart, also where pages are repeated
        vector = (mix64(np.array([x & 0xFFFFFFFFFFFFFFFF for x in cols[5]], np.uint64)) >> np.uint64(24)).astype(np.int64)
        ints = lambda i: pa.array(cols[i], pa.int64())
        arrays = [pa.array(cols[0], pa.string()), ints(1), ints(2), pa.array(cols[3], pa.string()), ints(4), pa.array(vector), *[ints(i) for i in (6, 7, 8, 9)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split(" ")[0] for x in _TOKENS.split(", ")])


def _drop_words(label: str) -> frozenset[str]:
    """The words of an element's class, id and role that mark what is no article."""
    names = label.partition(".")[2]
    return frozenset(w.lower().strip("-_ ") for w in _DROP_NAMES.findall(names)) if names else frozenset()


def _by_name(label: str, in_main: bool, excused: frozenset[str] = frozenset()) -> str | None:
    """'drop' or 'main' where an element's own name says so; in_main: it stands inside an article or main; excused: words that name the article itself."""
    name, _, names = label.partition(".")
    # an article's own header holds its title
    own = {"header"} if in_main or (names and _MAIN_NAMES.search(names)) else set()
    if name in _DROP_TAGS or (names and _drop_words(label) - excused - own) or (name == "header" and not in_main):
        return "drop"
    return "main" if name in _MAIN or (names and _MAIN_NAMES.search(names)) else None


def _overruled(rows: dict, order: list[int], slots: set[int], above: dict[int, int], box) -> int | None:
    """The slot whose drop name the template contradicts: it holds FOLLOW of the text that varies on its pages.

    order: elements, parents first; above: the topmost dropped element of those below one.
    Text counts for the slot that holds it, on the pages of a candidate's own class and on
    all pages of the host. Readers' comments vary too: their name holds unless nothing else
    varies.
    """
    most = max(r.pages for r in rows.values())
    free: Counter = Counter()  # by class: varying unlinked characters a page outside named elements
    telling: Counter = Counter()  # of them, in elements with an article's name
    held: Counter = Counter()
    slot_of: dict[int, int] = {}
    inside_main: set[int] = set()
    for path in order:
        r = rows[path]
        slot_of[path] = path if path in slots and box(path) else slot_of.get(r.parent, path)
        if r.parent in inside_main or _by_name(r.label, False) == "main":
            inside_main.add(path)
        varying = 0 if r.said_lo == r.said_hi else max(0, r.chars - r.linked - r.fixed)
        if path in above:
            held[above[path]] += varying
            continue
        slot = rows[slot_of[path]]
        free[slot.pages, slot.vector] += varying / slot.pages
        if path in inside_main:
            telling[slot.pages, slot.vector] += varying / slot.pages
    everywhere = lambda sums: sum(n for (pages, _), n in sums.items() if pages == most)
    best, most_held = None, 0.0
    for path, chars in held.items():
        r = rows[path]
        if path not in slots or not box(path) or r.label.partition(".")[0] in _DROP_TAGS or r.label.partition(".")[0] == "header":
            continue
        here, key = chars / r.pages, (r.pages, r.vector)
        beside = everywhere(free) + (free[key] if r.pages < most else 0)
        named = everywhere(telling) + (telling[key] if r.pages < most else 0)
        comments = any(_COMMENTS.match(w) for w in _drop_words(r.label))
        share = FIRM if named else FOLLOW
        if here > most_held and (beside == 0 if comments else here >= share * (here + beside)):
            best, most_held = path, here
    return best


def deduce(tokens: pd.DataFrame) -> dict[int, str]:
    """The template of one host: path id -> 'main' for slots that hold its article, 'keep' for
    those whose names the template overrules on the way to it, 'drop' for those of mere template.

    tokens: one row an element on two pages or more: path, parent, label, times, pages,
    vector, before_lo, before_hi, chars, linked, said_lo, said_hi, fixed (characters of the
    words that stand in it on all its pages).
    """
    rows = {r.path: r for r in tokens.itertuples()}
    classes: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    children: dict[int, list[int]] = defaultdict(list)
    for r in rows.values():
        classes[r.pages, r.times, r.vector].append(r.path)
        children[r.parent].append(r.path)
    if max((r.pages for r in rows.values()), default=0) < 2:
        return {}
    slots = {p for (pages, times, _), members in classes.items() for p in members if times == pages and (rows[p].before_lo == rows[p].before_hi or len(members) > 1)}
    roots = [p for p, r in rows.items() if r.parent not in rows]

    def box(path: int) -> bool:
        name = rows[path].label.partition(".")[0]
        return name not in _INLINE and name not in _BLOCKS

    overruled: set[int] = set()
    while True:
        order: list[int] = []
        above: dict[int, int] = {}  # below a dropped element: the topmost one
        excused: dict[int, frozenset[str]] = {}
        in_main: dict[int, bool] = {}
        todo = list(roots)
        while todo:
            path = todo.pop()
            order.append(path)
            r = rows[path]
            words, inside = excused.get(r.parent, frozenset()), in_main.get(r.parent, False)
            if path in overruled:
                words |= _drop_words(r.label)
            excused[path], in_main[path] = words, inside or r.label.partition(".")[0] in _MAIN
            if r.parent in above:
                above[path] = above[r.parent]
            elif _by_name(r.label, inside, words) == "drop":
                above[path] = path
            todo += children[path]
        more = _overruled(rows, order, slots, above, box)
        if more is None:
            break
        overruled.add(more)
    mass: Counter = Counter()
    linked: Counter = Counter()
    size: Counter = Counter()
    for path in reversed(order):  # below each element: varying unlinked characters, all and linked ones
        r = rows[path]
        if path not in above:
            mass[path] += 0 if r.said_lo == r.said_hi else max(0, r.chars - r.linked - r.fixed)
            size[path] += r.chars
            linked[path] += r.linked
            for total in (mass, size, linked):
                total[r.parent] += total[path]
    roles = dict.fromkeys(overruled, "keep")
    # follow the slot with most of the varying text; other layouts of the host have slots of their own
    todo = [p for p in roots if p not in above and p in slots]
    found = False
    while todo:
        path = todo.pop()
        here = mass[path] / rows[path].pages
        down = [c for c in children[path] if c in slots and c not in above and box(c) and here and mass[c] / rows[c].pages >= FOLLOW * here]
        todo += down
        if mass[path] and not any(rows[c].pages == rows[path].pages for c in down):
            roles[path] = "main"
            found = True
    # what an article's element holds beside it: constant or linked boxes
    for path in order:
        if path in above or path in roles or path not in slots or not box(path) or not size[path]:
            continue
        if (mass[path] == 0 and found) or linked[path] > LINKS * size[path]:
            roles[path] = "drop"
    return roles


def main_text(page: str | None, roles: dict[int, str]) -> str:
    """The page's article under a template.

    Outside the template's article everything goes; inside it, elements that the template or,
    where it is silent, their names drop. Pages without the template's slots are read by names alone.
    """
    elements, nodes = parse(page)
    known = any(roles.get(path) == "main" for path, _, _ in elements)
    own: list[str] = []
    in_main: list[bool] = []
    excused: list[frozenset[str]] = []
    for path, parent, label in elements:
        above, inside, words = (own[parent], in_main[parent], excused[parent]) if parent >= 0 else ("keep", False, frozenset())
        if roles.get(path) in ("main", "keep"):
            words |= _drop_words(label)
        excused.append(words)
        named = _by_name(label, inside, words)
        if above == "drop" or named == "drop" or roles.get(path) == "drop":
            role = "drop"
        else:
            role = "main" if above == "main" or (roles.get(path) if known else named) == "main" else "keep"
        own.append(role)
        in_main.append(inside or label.partition(".")[0] in _MAIN)
    kept = [(own[e] if e >= 0 else "keep", t, new) for e, t, _, new in nodes]
    wanted = "main" if any(r == "main" for r, _, _ in kept) else "keep"
    parts: list[list[str]] = []
    open_block = False
    for r, t, new in kept:
        if new or not parts:
            open_block = False
        if r == wanted:
            if not open_block:
                parts.append([])
            parts[-1].append(t)
            open_block = True
    texts = (re.sub(r"[ \t-\r]+", " ", markup.unescape("".join(p))).strip(" ") for p in parts)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    A page's host decides its template; hosts of one page are read by the names of their
    elements. Null and empty pages give an empty text, pages without url share the empty
    host. Repeated rows give equal texts and change no template but by their number; elements
    may be unclosed or nested to any depth, attributes malformed. A host's pages are counted
    where they are read, so one task gets no more of a host than its shared elements. Templates of all hosts are broadcast where they
    measure less than BROADCAST_LIMIT; beyond it they join the pages in SALTS copies a host.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    counted = rows.select("host", F.xxhash64("page_id", "url").alias("key"), "html").mapInArrow(_count_tokens, _TOKENS)
    tokens = counted.groupBy("host", "path").agg(
        F.first("parent").alias("parent"), F.first("label").alias("label"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("pages"), F.sum("vector").alias("vector"),
        F.min("before").alias("before_lo"), F.max("before").alias("before_hi"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("said").alias("said_lo"), F.max("said").alias("said_hi"),
    )
    # A token of a single page has no template to be part of. An element stands on all pages of
    # its words, so words of its highest count of pages are those that stand in it everywhere;
    # they are summed here, and only elements meet by host.
    word = F.col("label").isNull()
    element = F.struct(*[c for c in tokens.columns if c not in ("host", "pages")])
    by_pages = (
        tokens.where("pages > 1")
        .groupBy("host", F.when(word, F.col("parent")).otherwise(F.col("path")).alias("at"), "pages")
        .agg(F.sum(F.when(word & (F.col("times") >= F.col("pages")), F.col("chars"))).alias("fixed"), F.max(F.when(~word, element)).alias("element"))
    )
    shared = by_pages.groupBy("host", "at").agg(F.max(F.struct("pages", "fixed", "element")).alias("most")).where("most.element is not null")
    shared = shared.select("host", "most.element.*", "most.pages", F.coalesce("most.fixed", F.lit(0)).alias("fixed"))

    def per_host(key, frame: pd.DataFrame) -> pd.DataFrame:
        roles = deduce(frame)
        return pd.DataFrame({"host": [key[0]], "paths": [list(roles)], "roles": [list(roles.values())]})

    template = materialize(shared.groupBy("host").applyInPandas(per_host, "host string, paths array<long>, roles array<string>"), "templates")
    size = F.octet_length("host") + F.coalesce(F.aggregate("paths", F.lit(0), lambda a, _: a + 100), F.lit(0))
    out = "page_id long, url string, text string, n_chars long"

    def emit(batch, templates):
        texts = []
        for page, roles in zip(batch.column(3).to_pylist(), templates, strict=True):
            texts.append(main_text(page, roles))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    fields = ["page_id", "url", "host", "html"]
    if small_enough(template, size, BROADCAST_LIMIT):
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: dict(zip(r["paths"], r["roles"], strict=True)) for r in template.collect()})

        def run(batches):
            for batch in batches:
                yield emit(batch, [held.value.get(h, {}) for h in batch.column(2).to_pylist()])

        return materialize(rows.select(*fields).mapInArrow(run, out), "extracted")

    def run_joined(batches):
        for batch in batches:
            pairs = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            yield emit(batch, [dict(zip(p or [], r or [], strict=True)) for p, r in pairs])

    salted = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    joined = spread.join(salted.hint("shuffle_hash"), ["host", "salt"], "left").select(*fields, "paths", "roles")
    return materialize(joined.mapInArrow(run_joined, out), "extracted")


def op2_template_classes(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
