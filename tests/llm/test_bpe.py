"""op2 and op3: ids, texts and counts against the libraries; the digest cache."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from codequarry.llm import bpe, queries, token_counts
from codequarry.llm.common import new_path
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
FILES = [queries.WORD_BPE, queries.BYTE_BPE]
ODD = ["", " ", "a", "The CAT's", "é", "İI", "Σας", "\u0301x", "<|endoftext|>", "<|startoftext|>", "漢字", "🙂👍🏽", "\t\n", "  ", "123", "\x1c", "\u200b", "it's", "ﬁ", "\x00", "w" * 300, "...!?"]


def library(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.mark.parametrize("path", FILES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(ODD), max_size=8))
def test_codec_equals_the_library(path, parts):
    text, t = " ".join(parts) if len(parts) % 2 else "".join(parts), library(path)
    ids = bpe.codec(path).encode(text)
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
    assert bpe.codec(path).decode(ids) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_merges_in_order_of_rank():
    r, letters = random.Random(1), "abc"
    for _ in range(200):
        pairs = list({(a, b) for a in [*letters, "ab", "bc", "ca"] for b in [*letters, "ab", "bc"] if r.random() < 0.5})
        r.shuffle(pairs)
        ranks = {p: i for i, p in enumerate(pairs)}
        symbols = [r.choice(letters) for _ in range(r.randint(0, 14))]
        plain = list(symbols)
        while found := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            _, i = min(found)
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert bpe.merge(symbols, ranks) == plain


def test_registered_codec(spark):
    t, got = library(queries.WORD_BPE), {r["doc_id"]: r for r in queries.op2_bpe_codec(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[d["doc_id"]][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_codec_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "x " * 200_000, 3), (1, "x " * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(df, queries.WORD_BPE)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(len(r["ids"]) for r in got.collect()) == [0, 0, 200_000, 200_000]
    assert bpe.round_trip(df.where("false"), queries.WORD_BPE).collect() == []


def test_registered_counts(spark):
    t, got = library(queries.WORD_BPE), {r["doc_id"]: r for r in queries.op3_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(t.encode(d["text"] or "", add_special_tokens=False).ids)
        assert got[d["doc_id"]][1:] == (len((d["text"] or "").encode()), n, n > 2048)


@pytest.mark.parametrize("path", [*FILES, public_tokenizers.path("piece_bpe_32k.model")])
def test_counts_of_every_kind_of_file(spark, path):
    texts = [None, "", "a  b", "a b", " a\tb\n", "<|endoftext|> x", "Grüße 漢字", "a  b"]
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in texts]
    else:
        want = [len(library(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = token_counts.count_tokens(df, path, new_path(spark, "counts"), 2)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(i, len((t or "").encode()), n, n > 2) for i, (t, n) in enumerate(zip(texts, want))]


def test_the_cache_spares_encoding(spark):
    cache = new_path(spark, "counts")
    rows = lambda: spark.read.parquet(cache).count()
    docs = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    count = lambda texts, path=queries.WORD_BPE: [r["n_tokens"] for r in token_counts.count_tokens(docs(texts), path, cache).orderBy("doc_id").collect()]
    first = count(["one two", "one  two", "three", "one two"])
    assert first[0] == first[1] == first[3] and rows() == 2  # white space is dropped by this tokenizer anyway
    assert count(["three", "one two"]) == [first[2], first[0]] and rows() == 2
    assert len(count(["three", "four five six"])) == 2 and rows() == 3
    count(["three"], queries.BYTE_BPE)
    assert rows() == 4
    # a count that two jobs appended counts once, and what the cache says is taken
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    again = token_counts.count_tokens(docs(["three", "three"]), queries.WORD_BPE, cache + "-twice")
    assert [r["n_tokens"] for r in again.collect()] == [first[2]] * 2


def test_counts_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9, 1)], "doc_id int, text string, content int, doc int, _content int, n_tokens int")
    got = token_counts.count_tokens(df, queries.WORD_BPE, new_path(spark, "counts"))
    assert got.collect()[0].asDict() == {"doc_id": 1, "content": 7, "doc": 8, "_content": 9, "n_bytes": 3, "n_tokens": 2, "over_limit": False}
    assert token_counts.count_tokens(df.where("false"), queries.WORD_BPE, new_path(spark, "counts")).collect() == []


def test_a_hot_content_is_split(spark):
    confs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df = spark.range(200_000).selectExpr("id as doc_id", "case when id % 20 > 0 then 'hot' else concat('text ', id % 5000) end as text").repartition(8)
        out = token_counts.count_tokens(df, queries.WORD_BPE, new_path(spark, "counts"))
        assert out.count() == 200_000
        rows = out.collect()
        assert len(rows) == 200_000 and "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
