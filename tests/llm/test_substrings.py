"""op8: removed words against a dictionary of all windows; names that collide; very long texts."""

import hashlib
import random

import pytest
from codequarry.llm import queries, substrings
from codequarry.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """rows: (doc_id, text), ids distinct. (doc_id, n_words, n_removed, kept) of each."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in substrings.remove_repeats(df, Scratch(spark)).select("doc_id", "n_words", "n_removed", "kept").collect())


def test_registered(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(docs)]
    assert sorted(tuple(r) for r in queries.op8_substring_dedup(spark, SF).collect()) == want


@pytest.mark.parametrize("letters", [2, 3, 60])
def test_random_texts(spark, letters):
    r = random.Random(letters)
    words = [f"w{i}" for i in range(letters)]
    passages = [[r.choice(words) for _ in range(r.randint(5, 60))] for _ in range(15)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(r.randint(0, 6)):
            text += r.choice(passages)[r.randint(0, 5) :] if r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(1, 40))]
        rows.append((d, r.choice([" ", "\n", "\t  "]).join(text)))
    assert run(spark, rows) == brute(rows)


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_words_whose_names_collide(spark):
    rest = " ".join(f"word{i}" for i in range(19))
    rows = [(1, f"{thue_morse(2048, 'a', 'b')} {rest}"), (2, f"{thue_morse(2048, 'b', 'a')} {rest}")]
    assert run(spark, rows) == brute(rows) and brute(rows)[1][2] == 0


def test_every_word_has_one_name(spark, monkeypatch):
    # names that tell nothing: all is a candidate, and the digest alone decides
    monkeypatch.setattr(substrings, "mix", lambda x: x * 0)
    r = random.Random(9)
    rows = [(d, " ".join(r.choice("abcdefgh") for _ in range(50)) + " " + "x y z " * (d % 3 * 8)) for d in range(20)]
    assert run(spark, rows) == brute(rows)


def test_pieces_hold_every_window_once():
    r = random.Random(4)
    for _ in range(200):
        words = ["é" * r.randint(1, 9) for _ in range(r.randint(0, 120))]
        text = (r.choice(["", "  "]) + r.choice([" ", "\n\t "]).join(words)).encode()
        window, most = r.randint(1, 8), r.randint(1, 90)
        starts = []
        for before, piece in substrings.pieces(text, window, most):
            own = piece.split()
            assert own == text.split()[before : before + len(own)]
            starts += range(before, before + len(own) - window + 1)
        assert starts == list(range(len(words) - window + 1))


def test_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(6)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[500:900] + ["x"] * 45 + base[100:140])), (3, "y " * 5), (4, None), (5, "")]
    want = brute(rows)
    assert run(spark, rows) == want
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "PIECE", 700)
    # the workers of local mode are forks that read the module anew, so the pieces are tried here as well
    batch = df.toPandas()
    for text in batch["text"].dropna():
        assert b" ".join(text.encode().split()[:1]) == b" ".join(next(iter(substrings.pieces(text.encode(), 20, 700)))[1].split()[:1])
    assert run(spark, rows) == want


def test_edges(spark):
    words = " ".join(f"a{i}" for i in range(30))
    rows = [(None, words, 1, "x"), (1, words, 2, "x"), (1, words, 2, "x"), (1, words + " more", 3, None), (2, None, 4, "y"), (3, " \n", 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ranges int, lo string")
    got = sorted(((r["doc_id"], r["ranges"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, Scratch(spark)).collect()), key=repr)
    assert [g[:4] for g in got] == sorted([(None, 1, 30, 0), (1, 2, 30, 30), (1, 2, 30, 30), (1, 3, 31, 30), (2, 4, 0, 0), (3, 5, 0, 0)], key=repr)
    assert substrings.remove_repeats(df.where("false"), Scratch(spark)).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, Scratch(spark), 5)
