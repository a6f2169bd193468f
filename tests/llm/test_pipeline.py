"""The pipeline's stages against plain versions of them, at the smallest size and on edge cases."""

import __spark_entry__
import corpus_pipeline as cp
import pytest
from codequarry.llm import pii, quality, simhash
from test_packing import check

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(cp.STAGES)


def near(rows):
    """Indexes of rows that stay: the first of each component, by all pairs."""
    prints = [simhash.fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, i)
        if key < best.get(root(i), (True, 2**70, 0)):
            best[root(i)] = key
    return sorted(k[2] for k in best.values())


def without_repeats(rows, window=20):
    """Texts after all words of windows that occur earlier are gone. rows: (doc_id, text) in order of id."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append(text if not gone else b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def test_stages_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    good = cp.quality_rules(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    rows = [tuple(r) for r in good.orderBy("doc_id").collect()]
    assert rows == [r for r in given if r[0] in kept]

    single = cp.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), SF)
    assert single.columns == docs.columns
    rows = [rows[i] for i in near(rows)]
    assert sorted(map(tuple, single.collect())) == sorted(rows)

    cut = cp.repeated_passages(spark, spark.createDataFrame(rows, docs.schema), SF)
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, without_repeats([r[:2] for r in sorted(rows)]))]
    rows = sorted(map(tuple, cut.collect()))
    assert cut.columns == docs.columns and rows == sorted(want)

    clean = cp.personal_data(spark, spark.createDataFrame(rows, docs.schema), SF)
    base = [pii.base_spans(r[1]) for r in rows]
    more = pii.find_all([r[1] for r in rows], pii.trained(), base)
    texts = [pii.redact_text(r[1], b + m) for r, b, m in zip(rows, base, more)]
    rows = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == rows
    assert not any(pii.base_spans(t) for t in texts)

    pieces = cp.packed(spark, spark.createDataFrame(rows, docs.schema), SF)
    check([r[:2] for r in rows], pieces.collect())
    whole = __spark_entry__.queries()["pipeline"](spark, SF)
    total = lambda rows: sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert total(whole.collect()) == total(pieces.collect())


EDGES = [
    (1, "one two three " * 30, "en", "a", 5),
    (1, "one two three " * 30, "en", "a", 5),
    (1, "other words under the same id " * 9, None, None, None),
    (2, None, "en", "a", None),
    (3, "", "xx", "a", 0),
    (None, "a text without an id but with words " * 8, "en", "b", 1),
    (4, " ".join(f"w{i}" for i in range(300_000)), "en", "b", 1),
    (5, "mail x.1@mail2.example.com\n\nnow", "en", "b", 1),
]


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, name):
    rows = STAGES[name](spark, spark.createDataFrame(EDGES, SCHEMA), SF).collect()
    if name != "packing":
        by = {(r["doc_id"], (r["text"] or "")[:3]) for r in rows}
    if name == "quality rules":
        assert {r["doc_id"] for r in rows} <= {1, 4, None}
    elif name == "SimHash near-dedup":
        assert by == {(1, "one"), (1, "oth"), (2, ""), (4, "w0 "), (5, "mai"), (None, "a t")} and len(rows) == 6
    elif name == "substring dedup":
        assert len(rows) == len(EDGES) and any(r["text"] is None for r in rows)
        assert [r["text"] for r in rows if r["doc_id"] == 5] == ["mail x.1@mail2.example.com\n\nnow"]
    elif name == "PII":
        assert len(rows) == len(EDGES) and [r["text"] for r in rows if r["doc_id"] == 5] == ["mail <EMAIL>\n\nnow"]
    else:
        check([e[:2] for e in EDGES], rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table_and_other_columns(spark, name):
    empty = spark.createDataFrame([], SCHEMA + ", kept int, ranges string, own int, doc string, _did int, nth int, base int, spans int, fp string, changed int")
    out = STAGES[name](spark, empty, SF)
    assert out.collect() == [] and (name == "packing" or out.columns == empty.columns)
    row = ("some words " * 40, "en", "s", 1, 1, "r", 1, "d", 1, 1, 1, 1, "f", 1)
    full = spark.createDataFrame([(1, *row), (2, None, *row[1:])], empty.schema)
    out = STAGES[name](spark, full, SF)
    assert name == "packing" or out.columns == empty.columns
    for r in out.collect() if name != "packing" else []:
        assert (r["kept"], r["ranges"], r["own"], r["doc"], r["fp"], r["changed"]) == (1, "r", 1, "d", "f", 1)


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "PII", "packing"]
