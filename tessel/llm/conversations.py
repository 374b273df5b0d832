"""Repair of damaged conversations with the fewest costs, by layers of reachable grammar states.

A repaired conversation's role initials read (s?(ua)+)?. For each turn there is, for every
cost, a bitset of the grammar states from which the turns from there on can be repaired at
that cost; four bits a cost, all costs of a turn in one integer, so an edit is a shift by
its cost and a choice of bits. States that lie further than the lowest layer of each are
dropped, and an integer is kept relative to its lowest layer, so few different ones occur
and a transition is looked up after it was made once. Layers run from the last turn to the
first; the first layer of the start state gives the cost, and following its bits forward,
always by the least letter that keeps to the layer, gives the least audit.

Texts are shuffled once. What decides an audit (turn, role, a digest of the text, its fault)
travels first, without texts; then audits and texts meet, sorted, and repaired conversations
stream by. A conversation costs a task three bytes a row and its audit, not its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import WS, arrow_batches, free_caches, materialize, table

#: Costs of the edits, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or an assistant turn that the grammar asks for next.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The code of initials, and of faults; a turn's class is four times its fault and its initial.
_INITIALS = {"s": 0, "u": 1, "a": 2}
FINE, CUT, GONE = 0, 1, 2

# --- damage ---


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a seeded damage: conv_id, turn, role, text, lost.

    crc32 of `conv_id:turn` modulo 20 decides: 0 loses the row (it stays with lost = true,
    to name its conversation), 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes
    it a user's. Nulls of role, text and in the hashed key are one space.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), either("role").alias("role"), either("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), times.alias("copy")).drop("copy")


# --- layers ---

_WIDTH = 64
_ONES = sum(1 << 4 * c for c in range(_WIDTH))  # state 0 of every layer


def _costs(state: int, layers: int) -> int:
    """The layers that hold a state, as the places of state 0."""
    return layers >> state & _ONES


def _closed(layers: int) -> int:
    """layers with what up to two insertions reach, and only the lowest layer of each state."""
    for _ in range(2):
        for state, to in _NEXT.items():
            layers |= _costs(to, layers) << state + 4 * INSERT
    low = 0
    for state in range(4):
        found = _costs(state, layers)
        low |= (found & -found) << state
    return low


#: Behind the last turn the start and the assistant state accept, at no cost.
END = _closed(1 << START | 1 << ASSISTANT)


def _moves(state: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn of this class in a state, least letter first: letter, cost, state after it."""
    fault, initial = divmod(kind, 4)
    yield "D", DELETE, state
    if fault == GONE:
        return
    more = TRUNCATED if fault == CUT else 0
    if initial == _INITIALS["s"] and state == START:
        yield "K", KEEP + more, SYSTEM
    elif initial == (_INITIALS["u"] if _NEXT[state] == USER else _INITIALS["a"]):
        yield "K", KEEP + more, _NEXT[state]
    yield "R", REROLE + more, _NEXT[state]


@cache
def before(layers: int, kind: int) -> tuple[int, int]:
    """The layers ahead of a turn of this class, from those behind it, and how far they were lowered."""
    out = 0
    for state in range(4):
        for _, cost, to in _moves(state, kind):
            out |= _costs(to, layers) << state + 4 * cost
    out = _closed(out)
    down = ((out & -out).bit_length() - 1) // 4
    return out >> 4 * down, down


def _lowest(state: int, layers: int) -> int:
    return (_costs(state, layers).bit_length() - 1) // 4


@cache
def trace(state: int, kind: int, layers: int) -> tuple[str, int]:
    """The least letters, up to a turn's own, that stay on the lowest layers, and the state after them; layers: those behind the turn."""
    ahead, down = before(layers, kind)
    letters = ""
    while True:
        left = _lowest(state, ahead) + down
        step = next(((a, to) for a, cost, to in _moves(state, kind) if a == "D" and _lowest(to, layers) + cost == left), None)
        if step is None and _lowest(_NEXT[state], ahead) + down + INSERT == left:
            letters, state = letters + "I", _NEXT[state]
            continue
        step = step or next((a, to) for a, cost, to in _moves(state, kind) if _lowest(to, layers) + cost == left)
        return letters + step[0], step[1]


def least_audit(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns of these classes; of equal ones the ASCII-least."""
    layers, total = END, 0
    number: dict[int, int] = {END: 0}
    seen, behind = [END], array("H")
    for kind in reversed(kinds):
        behind.append(number[layers])
        layers, down = before(layers, kind)
        total += down
        if layers not in number:
            number[layers] = len(seen)
            seen.append(layers)
    total += _lowest(START, layers)
    letters, state = [], START
    for kind in kinds:
        some, state = trace(state, kind, seen[behind.pop()])
        letters.append(some)
    letters.append({START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state])
    return total, "".join(letters)


# --- audits ---

_AUDITS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_AUDITS_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LOST, _BLANK, _DUPLICATE, _TRUNCATED, _FINE = range(5)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks over rows sorted by conversation and turn: conv_id, turn, initial, fault."""
    free_caches()
    known: dict[bytes, tuple[int, str]] = {}  # short conversations repeat their classes
    nothing = object()
    conv, kinds, counts, illegal, turns, low, high, last, initial = nothing, bytearray(), [0] * 5, 0, 0, None, None, None, None
    out: list[tuple] = []

    def finished() -> tuple:
        key = bytes(kinds) if len(kinds) <= 32 else None
        cost_audit = known.get(key) if key is not None else None
        if cost_audit is None:
            cost_audit = least_audit(kinds)
            if key is not None and len(known) < 100_000:
                known[key] = cost_audit
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv, gaps, counts[_BLANK], counts[_DUPLICATE], counts[_TRUNCATED], illegal, *cost_audit)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _AUDITS, strict=True)], schema=_AUDITS)

    kind_of = {_BLANK: 4 * GONE, _DUPLICATE: 4 * GONE, _TRUNCATED: 4 * CUT, _FINE: 4 * FINE}
    for batch in batches:
        for this, turn, first, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if this != conv or conv is nothing:
                if conv is not nothing:
                    out.append(finished())
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
                conv, kinds, counts, illegal, turns, low, high, last, initial = this, bytearray(), [0] * 5, 0, 0, None, None, None, None
            if fault == _LOST:
                continue
            counts[fault] += 1
            kinds.append(kind_of[fault] + first)
            if initial is not None and (initial, first) not in _LEGAL:
                illegal += 1
            initial = first
            if turn is not None and turn != last:
                turns, low, high, last = turns + 1, turn if low is None else low, turn, turn
    if conv is not nothing:
        out.append(finished())
    if out:
        yield batch_of(out)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with a digest of the text, which orders turns that tie."""
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


#: A conversation's order: turn (nulls first), then role and text digest; lost rows carry no place.
def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, lost): gaps, blank, duplicate, truncated, illegal, cost, audit.

    Faults count once a row, in that order. A null conv_id is a conversation of its own; one
    with lost rows only has zeros and an empty audit; an empty table gives no rows.
    """
    said = _keyed(rows).withColumn("end", F.right(F.rtrim("text", F.lit(WS)), F.lit(1)))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _INITIALS.items() for x in pair]), F.substring("role", 1, 1)), F.lit(3))
    small = said.select("conv_id", "turn", "role", "digest", "lost", "end", initial.alias("initial")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("lost"), _LOST).when(F.col("end") == "", _BLANK).when(seen > 1, _DUPLICATE).when(~F.col("end").isin(".", "!", "?"), _TRUNCATED).otherwise(_FINE)
    judged = small.withColumn("fault", fault).sortWithinPartitions(*_order())
    return judged.select("conv_id", "turn", "initial", "fault").mapInArrow(_audit_rows, _AUDITS_DDL)


# --- repaired conversations ---


def _repaired(digest: bool) -> Callable:
    """Tasks over rows sorted by conversation, each conversation's audit ahead of its turns."""
    if digest:
        schema = pa.schema([*_AUDITS, ("repaired_sha256", pa.string())])
    else:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        out: list[tuple] = []
        size = 0
        report, sha, audit, at, place, state = None, None, "", 0, 0, START

        def say(role: str, text: bytes) -> None:
            nonlocal place, size
            if digest:
                sha.update((b"\n" if place else b"") + role.encode() + b":" + text)
            else:
                out.append((report[0], place, role, text.decode()))
                size += len(text)
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                say(_ROLES[state], b"")
                at += 1

        def finish() -> None:
            inserted()
            if digest:
                out.append((*report, sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, said, role, text, *told in zip(*columns, strict=True):
                if not said:
                    if report is not None:
                        finish()
                    report, sha, audit, at, place, state = (conv, *told), hashlib.sha256(), told[-1], 0, 0, START
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = SYSTEM if state == START and role[:1] == "s" else _NEXT[state]
                    say(role, text)
                elif edit == "R":
                    state = _NEXT[state]
                    say(_ROLES[state], text)
                if len(out) >= 5000 or size > 8 << 20:
                    yield batch_of()
                    out, size = [], 0
        if report is not None:
            finish()
        if out:
            yield batch_of()

    return run


def _joined(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    told = [f.name for f in _AUDITS if f.name != "conv_id"]
    nothing = lambda kind: F.lit(None).cast(kind)
    turns = _keyed(rows.where(~F.col("lost"))).select("conv_id", F.lit(True).alias("said"), "turn", "role", F.col("text").cast("binary").alias("text"), "digest", *[nothing("string" if c == "audit" else "long").alias(c) for c in told])
    heads = found.select("conv_id", F.lit(False).alias("said"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("binary").alias("text"), nothing("binary").alias("digest"), *told)
    first, *rest = _order()
    dealt = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(first, "said", *rest)
    shape = f"{_AUDITS_DDL}, repaired_sha256 string" if digest else "conv_id long, place long, role string, text string"
    return dealt.select("conv_id", "said", "role", "text", *told).mapInArrow(_repaired(digest), shape)


def repaired_messages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), role, text. found: audits(rows)."""
    return _joined(rows, found, False)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256, of the repaired turns as `role:text`, newline-joined."""
    return _joined(rows, found, True)


def op11_cost_layers(spark, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    with arrow_batches(spark):
        return materialize(repaired_digests(rows, materialize(audits(rows), "audits", light=True)), "repaired")


_CRC32 = "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"


def _sql_edit(state: str, letter: str, cost: str, said: str = "") -> str:
    more = f"list_append({state}.o, {said})" if said else f"{state}.o"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {more}}}"


def _sql_closed(s: list[str]) -> str:
    """Columns s0 to s3 with what insertions reach, from the four given ones."""
    insert = lambda x, role: _sql_edit(x, "I", "5", f"'{role}:'")
    s2 = f"least({s[2]}, {insert(s[0], 'user')}, {insert(s[1], 'user')}, {insert(s[3], 'user')})"
    return f"{s[0]} AS s0, {s[1]} AS s1, {s2} AS s2, least({s[3]}, {insert(s2, 'assistant')}) AS s3"


_STAY = [_sql_edit(f"w.s{k}", "D", "2") for k in range(4)]


def _sql_said(state: str, initial: str, role: str) -> str:
    """Keep the turn where its initial fits, else change its role; unaffordable where it must go."""
    keep = _sql_edit(state, "K", "f.more", "f.role || ':' || f.text")
    change = _sql_edit(state, "R", "1 + f.more", f"'{role}:' || f.text")
    return f"CASE WHEN f.r = '{initial}' THEN {keep} ELSE {change} END"


_STEP = (
    f"{_STAY[0]} AS t0, least({_STAY[1]}, CASE WHEN f.r = 's' THEN {_sql_edit('w.s0', 'K', 'f.more', chr(39).join(['f.role || ', ':', ' || f.text']))} ELSE {_STAY[1]} END) AS t1, "
    f"least({_STAY[2]}, {_sql_said('w.s0', 'u', 'user')}, {_sql_said('w.s1', 'u', 'user')}, {_sql_said('w.s3', 'u', 'user')}) AS t2, least({_STAY[3]}, {_sql_said('w.s2', 'a', 'assistant')}) AS t3"
)
_FAR = "{'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}"

#: The same repairs in DuckDB: one row a conversation and turn, with the least cost, audit and turns for each grammar state.
SQL = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 c AS (SELECT *, {_CRC32} % 20 AS d FROM k),
 m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE d <> 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM m),
 q AS (SELECT *, role[1] AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM p),
 f AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS more FROM q),
 z AS (SELECT DISTINCT conv_id FROM conversations),
 w AS (SELECT conv_id, 0::BIGINT AS i, {_sql_closed(["{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}", _FAR, _FAR, _FAR])} FROM z
  UNION ALL SELECT conv_id, i, {_sql_closed(["t0", "t1", "t2", "t3"])} FROM (SELECT w.conv_id, f.i, {_STEP} FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)),
 e AS (SELECT conv_id, arg_max(least(s0, s3), i) AS b FROM w GROUP BY conv_id),
 g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND was || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
 SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256 FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id"""
