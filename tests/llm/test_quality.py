"""op6: texts without common words and link lists are rejected, clean ones stay, whatever the reference."""

import random
import re
from collections import Counter

import pytest
from codequarry.llm import quality, queries

NOUNS = "house river garden window market teacher village morning letter bridge summer forest paper table station picture winter number doctor kitchen".split()


def clean(seed):
    r = random.Random(seed)
    words = [r.choice(quality.COMMON_WORDS["en"]) if r.random() < 1 / 6 else r.choice(NOUNS) + r.choice(["", "s", "ly"]) for _ in range(300)]
    return ". ".join(" ".join(words[i : i + 10]).capitalize() for i in range(0, 300, 10)) + "."


def bare(seed):
    r = random.Random(seed)
    words = [r.choice(NOUNS) + r.choice(["", "s", "ly"]) for _ in range(300)]
    return ". ".join(" ".join(words[i : i + 10]).capitalize() for i in range(0, 300, 10)) + "."


def links(seed):
    r = random.Random(seed)
    return " | ".join((r.choice(NOUNS) + r.choice(["", "s", "ly"])).capitalize() for _ in range(150))


def few_words_links(seed):
    """A link list in which a common word stands as often as in prose."""
    return " | ".join(clean(seed).split()[:150])


@pytest.mark.parametrize("junk", [0, 30])
def test_junk_goes_and_clean_texts_stay(spark, junk):
    rows = [("clean", clean(i)) for i in range(60)] + [("bare", bare(i)) for i in range(3 + junk)] + [("links", links(i)) for i in range(3)] + [("few", few_words_links(i)) for i in range(3)]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "kind string, text string, lang string")
    for r in quality.judge(df).collect():
        assert not r["base_failed"]
        assert r["kept"] == (r["kind"] == "clean"), (r["kind"], r["chars_js"], r["words_js"])


def test_bar_counts_as_a_symbol_still(spark):
    df = spark.createDataFrame([("a | b # c", "en"), (None, None), ("", "xx")], "text string, lang string")
    got = quality.judge(df).select("n_symbols", "kept").collect()
    assert [tuple(r) for r in got] == [(2, False), (0, False), (0, False)]


def test_bare_divergence_is_that_of_a_text_without_common_words(spark):
    from pyspark.sql import functions as F

    ref = [50, 30, 20, 500]
    js = spark.range(1).select(quality.divergence(F.expr("array(0d, 0d, 0d, 100d)"), F.array(*(F.lit(float(x)) for x in ref)))).first()[0]
    assert abs(js - quality.bare_divergence(ref)) < 1e-12
    assert quality.bare_divergence([0, 0, 5]) is None


def base_columns(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, by the letter of the contract."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_columns_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op6_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == base_columns(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_base_columns_on_edges(spark):
    texts = [None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "l\nl\n\n \n \nl \nl", "é🙂 # * $ % & | < > \x1c y", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8", "\r\na\r\na", "z" * 100_000]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id int, text string, lang string, kept int")
    got = quality.judge(df).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [base_columns(t) for t in texts]
    assert quality.judge(df.where("false")).collect() == []
    assert quality.judge(df).columns[:3] == ["doc_id", "text", "lang"]
