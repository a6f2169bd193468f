"""op7: every document's ids come back from its pieces, and sequences are filled without gaps."""

import time
import zlib
from collections import Counter, defaultdict

import __spark_entry__
import numpy as np
import pytest
import tokenizers
from codequarry.llm import packing, queries
from codequarry.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def expected_ids(texts):
    library = tokenizers.Tokenizer.from_file(queries.BYTE_BPE)
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def check(docs, rows, size=1024):
    """docs: (doc_id, text), rows: what pack() gives. Documents are told apart by their ids' CRCs, so ids may repeat."""
    wanted = Counter()
    for (doc, _), ids in zip(docs, expected_ids([t for _, t in docs])):
        wanted[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    if len({d for d, _ in docs}) == len(docs):
        for (doc, _), ids in zip(docs, expected_ids([t for _, t in docs])):
            at, whole = 0, []
            for r in sorted(pieces[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
                part = ids[at : at + r["length"]]
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
                whole.append(part)
                at += r["length"]
            assert at == len(ids) and (np.concatenate(whole) == ids).all()
    assert sum(r["length"] for r in rows) == sum(n * c for (_, n, _), c in wanted.items())
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    fills = []
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        fills.append(at)
    # one pack at most stays short, and that one is cut at distinct powers of two
    short = [f for f in fills if f < size]
    assert len(set(short)) == len(short) and all(f & (f - 1) == 0 for f in short)


def test_registered_over_the_whole_table(spark):
    rows = __spark_entry__.queries()["op7_shortest_pack_first"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in rows} == {d for d, _ in docs}
    check(docs, rows)


EDGES = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "  two  spaces \n\n\tx "), (6, "<|endoftext|> Ünï — 漢字 🙂"), (7, "word " * 3000), (8, "x" * 5000), (9, "one more")]


@pytest.mark.parametrize("size", [1024, 16, 1])
def test_edges(spark, size):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    check(EDGES, packing.pack(df, queries.BYTE_BPE, Scratch(spark), size).collect(), size)


def test_repeated_and_null_ids(spark):
    docs = [(1, "same text"), (1, "same text"), (None, "no id"), (None, "other"), (1, "differs " * 40)] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, queries.BYTE_BPE, Scratch(spark), 64).collect()
    check(docs, rows, 64)
    starts = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    wanted = Counter((d, len(i)) for (d, _), i in zip(docs, expected_ids([t for _, t in docs])))
    assert starts == wanted


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, queries.BYTE_BPE, Scratch(spark)).collect() == []


def test_plan_covers_every_histogram():
    random = np.random.default_rng(1)
    for _ in range(300):
        size = int(random.integers(1, 40))
        histogram = {int(n): int(random.integers(1, 30)) for n in random.integers(1, size + 1, random.integers(1, 12))}
        patterns = packing.plan(dict(histogram), size)
        assert all(0 < p.fill <= size for p in patterns) and len(patterns) <= 2 * len(histogram)
        found = packing.layout(patterns, size)
        held = defaultdict(list)
        for length, count in histogram.items():
            for rank in range(count):
                at = 0
                for start, used, sequence, offset in found.pieces(length, rank):
                    assert start == at and used > 0
                    at += used
                    held[sequence].append((offset, used))
                assert at == length
        assert sorted(held) == list(range(found.sequences))
        fills = []
        for spans in held.values():
            at = 0
            for offset, used in sorted(spans):
                assert offset == at
                at += used
            fills.append(at)
        short = [f for f in fills if f < size]
        assert max(fills) <= size and len(set(short)) == len(short) and all(f & (f - 1) == 0 for f in short)


def test_plan_stays_small_and_fast():
    for count in (1, 50, 5_000, 500_000):
        began = time.process_time()
        patterns = packing.plan({n: count + n % 7 for n in range(1, 1025)}, 1024)
        assert len(patterns) <= 2 * 1024
        assert sum(p.count for p in patterns for _ in p.parts) == sum(count + n % 7 for n in range(1, 1025))
        packing.layout(patterns, 1024)
        assert time.process_time() - began < 5


def test_encoder_equals_the_library_on_odd_texts():
    encode = packing.encoder(queries.BYTE_BPE)
    texts = ["", " ", "a  b\t\n c ", "x" * 9000, " " * 9000 + "y", "<|endoftext|>a<|endoftext|> b", "é🙂漢字\u200b\x00", "1234567 don't I'LL"]
    for text, want in zip(texts, expected_ids(texts)):
        assert [*encode(text).tolist(), 0] == want.tolist()
