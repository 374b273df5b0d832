"""Conversation repair, token codes and fill-in-middle against brute force and exact round trips."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm import conversations, middle, token_codes
from tessel.llm.conversations import audits, damaged, least_audit, op11_cost_layers, repaired_digests, repaired_messages
from tessel.llm.middle import boundaries, fill_in_middle, op13_distinct_text_index
from tessel.llm.packing import tokenizer_path
from tessel.llm.token_codes import PieceIds, encode, op12_addressable_codes, read_documents, token_at, tokens_at, tokens_between, write_codes

BYTES = "byte_bpe_50k.json"
TOKENIZER = Tokenizer.from_file(tokenizer_path(BYTES))
WS = " \t\n\x0b\x0c\r"

# --- 11 ---

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """Least (cost, audit, repaired turns) of turns (role, text, fault), by uniform-cost search over every edit."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if best.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(turns) and state in ("", "a"):
            return cost, audit, said
        to = NEXT[state]
        role = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*said, f"{role}:")))
        if i < len(turns):
            was, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, said))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if was[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s", (*said, f"{was}:{text}")))
                if was[:1] == to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*said, f"{was}:{text}")))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*said, f"{role}:{text}")))
    raise AssertionError


def true_repairs(rows):
    """Reports by conversation, straight from the rules, of (conv_id, turn, role, text) rows."""
    held = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, said in held.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in said:
            end = text.strip(WS)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in said if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit, repaired = cheapest([(r, x, f) for (_, r, x), f in zip(said, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def reports(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def odd_conversations():
    rnd = random.Random(5)
    texts = [None, "", " \t", "Yes.", "No!", "well", "so on ", "Why?\n", "ends. ", "é漢.", "\x0b", "a\x0bb ", "done.\x0c\r"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sys", "agent", "U"]
    return [(rnd.choice([None, *range(60)]), rnd.choice([None, *range(12), -3]), rnd.choice(roles), rnd.choice(texts)) for _ in range(700)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=9))
def test_least_audits(kinds):
    names, faults = {0: "s", 1: "u", 2: "a", 3: "x"}, {0: "", 1: "truncated", 2: "blank"}
    turns = [(names[i], "t", faults[f]) for f, i in kinds]
    assert least_audit(bytes(4 * f + i for f, i in kinds)) == cheapest(turns)[:2]


def test_layers_hold_every_state_and_cost():
    got = conversations.before(conversations.END, 1)  # a fine user turn before the end
    # nothing yet: delete; after a system turn: keep, insert; after a user's: change the role; after an assistant's: delete
    costs = {s: conversations._lowest(s, got[0]) + got[1] for s in range(4)}
    assert costs == {0: 2, 1: 5, 2: 1, 3: 2}


def test_conversations_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(op11_cost_layers(spark, small)) == true_repairs(rows)


def test_odd_conversations(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, audit string, lost boolean").repartition(3)
    hurt = damaged(df)
    found = audits(hurt)
    got = repaired_digests(hurt, found)
    assert reports(got) == true_repairs(rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    turns = defaultdict(list)
    for r in repaired_messages(hurt, found).collect():
        turns[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for c, report in reports(got).items():
        said = sorted(turns[c])
        assert [p for p, *_ in said] == list(range(len(said)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest() == report[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in said))
    assert repaired_digests(damaged(df.limit(0)), audits(damaged(df.limit(0)))).collect() == []


def test_a_long_conversation(spark):
    rnd = random.Random(2)
    rows = [(7, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice(["Fine %d." % t, "cut", "", "Again."])) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    hurt = damaged(df)
    assert reports(repaired_digests(hurt, audits(hurt))) == true_repairs(rows)


# --- 12 ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1200), st.data())
def test_any_token_is_read_alone(ids, data):
    levels = encode(np.array(ids, np.uint32))
    assert tokens_between(levels, 0, len(ids)).tolist() == ids
    assert [token_at(levels, i) for i in range(len(ids))] == ids
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert tokens_between(levels, first, last).tolist() == ids[first:last]


def test_full_directory_blocks():
    for n in (512, 1024, 1025, 5000):
        ids = [300_000 + i % 7 for i in range(n)]
        levels = encode(np.array(ids, np.uint32))
        assert tokens_between(levels, 0, n).tolist() == ids and token_at(levels, n - 1) == ids[-1]


def test_widths_need_the_fewest_bits():
    ids = np.array([1] * 1000 + [70_000] * 10, np.uint32)

    def bits(widths):
        left, total = ids, 0
        for k, w in enumerate(widths):
            total += len(left) * (w + (k < len(widths) - 1))
            left = left[left >> np.uint32(w) > 0] >> np.uint32(w)
        return total

    def splits(n):
        return [[]] if not n else [[w, *rest] for w in range(1, n + 1) for rest in splits(n - w)]

    assert bits(token_codes.best_widths(ids)) == min(map(bits, splits(17)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", "9", "12", "é", "漢", "\xa0", "\x1c", "\x85", "!", "...", "<|endoftext|>", "​", "_", "\r\n", "\x00", "y" * 70]), max_size=14))
def test_piece_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    got = np.frombuffer(PieceIds.at(tokenizer_path(BYTES))([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def stored(rows, text_of=lambda r: r[1]):
    """Expected (doc_id, start, n_tokens, crc) in order, straight from the tokenizer."""
    out, at = [], 0
    for r in rows:
        ids = [*TOKENIZER.encode(text_of(r) or "", add_special_tokens=False).ids, 0]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_stored_documents(spark, small):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in op12_addressable_codes(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == stored(rows)


def test_odd_documents_and_access(spark, tmp_path):
    rnd = random.Random(9)
    texts = [None, "", " ", "one", "two  words\n\n", "z" * 9000, " ".join(rnd.choice(["alpha", "beta", "Γ", "9"]) for _ in range(20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other"), (3, "one"), (3, "one"), (None, "none"), (-5, "less")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, part string, place int").repartition(3)
    folder = write_codes(df, tokenizer_path(BYTES), f"file://{tmp_path}/codes", segment=64)
    back = read_documents(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in back) == sorted(str(i) for i, _ in rows)
    back.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    flat = [x for r in back for x in r["ids"]]
    assert [r["start"] for r in back] == [sum(len(q["ids"]) for q in back[:k]) for k in range(len(back))]
    assert sorted(map(str, ((r["doc_id"], r["ids"]) for r in back))) == sorted(map(str, ((i, [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)))
    digests = {r["start"]: r["ids_crc32"] for r in read_documents(spark, folder, digest=True).collect()}
    assert digests == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in back}
    asked = [0, len(flat) - 1, len(flat), -1, None, *(rnd.randrange(len(flat)) for _ in range(300))]
    got = {r["place"]: r["id"] for r in tokens_at(spark, folder, spark.createDataFrame([(p,) for p in asked], "place long"), at_once=16).collect()}
    assert got == {p: flat[p] for p in asked if p is not None and 0 <= p < len(flat)}
    some = read_documents(spark, folder, doc_ids=(3, 4)).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 3, 3, 3, 4]
    empty = write_codes(df.limit(0), tokenizer_path(BYTES), f"file://{tmp_path}/empty")
    assert read_documents(spark, empty).collect() == [] and tokens_at(spark, empty, spark.range(3).toDF("place")).collect() == []


# --- 13 ---


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.integers(1, 4))
def test_boundaries_are_selected(text, times):
    text *= times
    index, at = boundaries(text.encode()), [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    assert index.n == len(text) + 1 and [index.select(i) for i in range(index.n)] == at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=200))
def test_select_with_low_bits(values):
    values = sorted(values)
    code = middle.EliasFano(np.array(values, np.int64))
    assert [code.select(i) for i in range(len(values))] == values


def true_middle(doc, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = text if form == "plain" else f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    chars = (None, None) if form == "plain" else (a, b - a)
    return (doc, n, form, *chars, out)


def test_cuts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((*(w := true_middle(*r))[:5], sha(w[5]), sha(r["text"])) for r in rows if true_middle(*r)[3] is not None)
    got = op13_distinct_text_index(spark, small)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(tuple(r) for r in got.collect() if r["prefix_chars"] is not None) == want
    assert got.count() == len(rows)


def odd_texts():
    texts = [None, "", " ", "a", "é", "漢字🎉", "has <P> in it", "x <S", "<", "<M>", "S>" * 9, "<<P" * 40, "é" * 500, "long " * 50_000]
    return [(i, t) for i, t in enumerate(texts * 3)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("hot", [64 << 20, 3000])
def test_odd_cuts(spark, monkeypatch, hot):
    monkeypatch.setattr(middle, "HOT_BYTES", hot)
    rows = odd_texts() + [(i, "the same text here") for i in range(1000, 1600)]
    df = spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "doc_id long, text string, key string, salt int, form string").repartition(5)
    got = sorted(map(str, (tuple(r) for r in fill_in_middle(df).collect())))
    assert got == sorted(map(str, (true_middle(*r) for r in rows)))
    digests = sorted(map(str, (r["restored_sha256"] for r in fill_in_middle(df, digest=True).collect())))
    assert digests == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert fill_in_middle(df.limit(0)).collect() == []


def test_a_list_is_made_once_a_text(spark, monkeypatch):
    """Copies share one list: a run ends only where the text changes."""
    made = []
    real = boundaries
    monkeypatch.setattr(middle, "boundaries", lambda t: made.append(t) or real(t))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([b"a", b"a", b"b", b"b"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in middle._runs(1, 10, 20, False)(iter([batch, batch.slice(2)]))) == 6
    assert made == [b"a", b"b"]


def test_forms_follow_their_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text of words").alias("text"))
    counts = {r["form"]: r["count"] for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 400) < 100 and abs(counts["spm"] - 720) < 130
