"""Substring dedup by recompression.

Words get global names (hashes), and rounds of recompression rename runs and
pairs of symbols: a run of two equal names, then every pair of a left and a
right symbol, sides being told by a bit of the name, becomes one symbol. A name
follows from its words alone, so all tasks agree on it. Whether a place between
words is still a boundary after the rounds depends on REACH words to each side,
and no symbol is longer than GAP; so any two equal windows have the same
boundaries and symbols in their interior, and at least one.

Each window is represented by the interior boundary of least key (its symbols and
the words within reach). Windows whose key occurs once in the corpus are unique.
The rest are verified by a cryptographic digest of their words, and the first in
order of document and place is kept. Names only find candidates: two words of one
name cost a comparison, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, text_slices

#: Rows that a task gathers before it resolves what repeats among them and passes on the rest.
FLUSH = 2_000_000
#: Bytes of text at a time: word names take some fifty times as much. Longer texts are read in pieces that overlap by a window.
PIECE = 1_000_000
REACH, GAP = 4, 4
_NONE = -(2**63)
_U = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_ODD = _random.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_names(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words `[^\\x20\\x09-\\x0D]+` of the texts, and the position where each text's words begin (and the end)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.array([], np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.array([], np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return np.array([], np.uint64), np.zeros(len(texts) + 1, np.int64)
    index = np.arange(len(raw))
    place = index - at[np.cumsum(first) - 1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    size = np.flatnonzero(last) - at + 1
    place[~inside] = 0
    names = np.add.reduceat(_BYTE[raw] * _powers(_ODD[0], int(size.max()))[place], at)
    return mix(names + size.astype(np.uint64) * _ODD[1]), np.searchsorted(at, ends)


def _sums(names: np.ndarray, odd: np.uint64) -> tuple[np.ndarray, np.uint64]:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * _powers(odd, len(names)), dtype=np.uint64)]), _U(pow(int(odd), -1, 2**64))


def sequence_names(names: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Names of all `length` consecutive words; none if there are fewer."""
    n = len(names) - length + 1
    if n <= 0:
        return np.array([], np.uint64)
    total, inverse = _sums(mix(names + _ODD[2 + salt]), _ODD[4 + salt])
    return mix((total[length:] - total[:-length]) * _powers(inverse, n) + _ODD[6])


def parse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where the symbols begin after all rounds, and the names of the symbols before the last one at each
    word (of the symbol that begins there, else 0). No symbol spans two documents."""
    start, name, of = np.arange(len(names)), names, doc

    # runs: two equal names, no more
    same = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    twin = same & ~before[:-1] & ~after[1:]
    name = np.where(np.concatenate([twin, [False]]), mix(name + _ODD[7]), name)
    span = np.where(np.concatenate([twin, [False]]), 2, 1)
    keep = ~np.concatenate([[False], twin])
    start, name, of, span = start[keep], name[keep], of[keep], span[keep]

    def pairs(level: int, cap: int) -> None:
        nonlocal start, name, of, span
        right = (mix(name + _U(level)) & _U(1)).astype(bool)
        joined = ~right[:-1] & right[1:] & (of[1:] == of[:-1]) & (span[:-1] + span[1:] <= cap)
        both = np.concatenate([joined, [False]])
        name = np.where(both, mix(name * _ODD[1] + np.concatenate([name[1:], name[:1]]) * _ODD[2] + _U(level)), name)
        span = np.where(both, span + np.concatenate([span[1:], span[:1]]), span)
        keep = ~np.concatenate([[False], joined])
        start, name, of, span = start[keep], name[keep], of[keep], span[keep]

    pairs(1, 2)
    lower = np.zeros(len(names), np.uint64)
    lower[start] = name
    pairs(2, GAP)
    return start, lower


def anchors(names: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents, and first and last window start (word positions within the document) that each represents."""
    none = (np.array([], np.uint64), *(np.array([], np.int64) for _ in range(3)))
    if len(names) < window:
        return none
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    start, lower = parse(names, doc)
    context = sequence_names(names, 2 * REACH, 0)
    start = start[(start >= REACH) & (start < REACH + len(context))]
    key = np.full(len(names), 2**64 - 1, np.uint64)
    key[start] = mix(context[start - REACH] + lower[start]) >> _U(1)
    # least key, then leftmost, of the boundaries REACH to window - REACH words after each start
    width = window - 2 * REACH + 1
    best, size = np.arange(len(names)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        best, size = np.where(key[left] <= key[right], left, right), size + step
    starts = np.arange(len(names) - window + 1)
    starts = starts[doc[starts] == doc[starts + window - 1]]
    if not len(starts):
        return none
    chosen = best[starts + REACH]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])])
    at = np.flatnonzero(new)
    low, high = starts[at], starts[np.concatenate([at[1:] - 1, [len(starts) - 1]])]
    where = doc[low]
    return key[chosen[at]], where, low - begins[where], high - begins[where]


def pieces(text: bytes, window: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(number of words before, piece) of a text: each window of words lies whole in one piece, and in one only."""
    before, at = 0, 0
    while len(text) - at > most:
        words = text[at : at + most].split()
        if not text[at + most : at + most + 1].isspace() and not text[at + most - 1 : at + most].isspace():
            words = words[:-1]  # cut short
        step = len(words) - window + 1
        if step <= 0:  # words of such length are read in one piece
            most *= 2
            continue
        yield before, b" ".join(words)
        rest = text[at : at + most].split(None, step)
        at += most - len(rest[step]) if len(rest) > step else most
        before += step
    yield before, text[at:]


def _in_pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(texts, row of each, words before each): the batch's texts, those beyond PIECE by pieces."""
    at = 0
    for part in text_slices(batch, "text", PIECE):
        texts = part.column("text")
        if part.num_rows == 1 and texts[0].is_valid and len(raw := texts[0].as_buffer()) > PIECE:
            for before, piece in pieces(raw.to_pybytes(), window, PIECE):
                yield pa.array([piece]).cast(pa.large_string()), np.array([at]), np.array([before])
        else:
            yield texts, np.arange(at, at + part.num_rows), np.zeros(part.num_rows, np.int64)
        at += part.num_rows


def digests(text: bytes, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of BLAKE2 of the words of each window (at: its first word), as a long and an int."""
    words = text.split()
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    make = hashlib.blake2b
    out = b"".join([make(joined[a:b], digest_size=12).digest() for a, b in zip(starts[at].tolist(), (starts[at + window] - 1).tolist())])
    both = np.frombuffer(out, [("long", "<i8"), ("int", "<i4")])
    return both["long"].copy(), both["int"].copy()


def _with_ids(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the columns that identify a document: its id (null: the least long) and, only where ids repeat, the
    hash of its text, so that rows that are equal are one document and others under one id are not."""
    out = docs.withColumns({"_did": F.coalesce("doc_id", F.lit(_NONE)), "_alt": F.lit(0).cast("long")})
    if out.groupBy("_did").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out, ["_did", "_alt"]
    return out.withColumn("_alt", F.xxhash64(F.coalesce("text", F.lit("")))), ["_did", "_alt"]


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows (key, _did, _alt, lo, hi, known). Of a key that repeats within a task, all rows are known to repeat and only
    one keeps the key; so a key has at most one row a flush, however common it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            key, did, alt, lo, hi = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, did, alt, lo, hi = (x[order] for x in (key, did, alt, lo, hi))
            equal = key[1:] == key[:-1]
            again, more = np.concatenate([[False], equal]), np.concatenate([equal, [False]])
            key = np.where(again, mix(did.view(np.uint64) * _ODD[1] + alt.view(np.uint64) + lo.view(np.uint64) * _ODD[2]) | _U(2**63), key)
            cols = [pa.array(x) for x in (key.view(np.int64), did, alt, lo.astype(np.int32), hi.astype(np.int32), again | more)]
            return pa.RecordBatch.from_arrays(cols, ["key", "_did", "_alt", "lo", "hi", "known"])

        for batch in batches:
            dids, alts = _long(batch, "_did"), _long(batch, "_alt")
            for texts, of, before in _in_pieces(batch, window):
                key, where, lo, hi = anchors(*word_names(texts), window)
                held.append((key, dids[of[where]], alts[of[where]], lo + before[where], hi + before[where]))
                rows += len(key)
                if rows >= FLUSH:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    return docs.select("_did", "_alt", "text").mapInArrow(run, "key long, _did long, _alt long, lo int, hi int, known boolean")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows (h1, h2, _did, _alt, lo, hi, known) of the windows in `ranges`. What is a repeat within a task is passed on
    as known ranges; of each sequence only the first place goes under its name (h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            h1, h2, did, alt, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((alt, did))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.concatenate([[0], ((did[order[1:]] != did[order[:-1]]) | (alt[order[1:]] != alt[order[:-1]])).cumsum()])
            code = (rank << 32) + pos
            order = np.lexsort((code, h1))
            h1, h2, did, alt, pos, code = (x[order] for x in (h1, h2, did, alt, pos, code))
            fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            repeat = code != code[head]
            # a second row of one document and place is the same document again
            single = fresh
            again = np.flatnonzero(repeat)[np.argsort(code[repeat], kind="stable")]
            c = code[again]
            ends = np.concatenate([c[1:] > c[:-1] + 1, [True]]) if len(c) else np.array([], bool)
            first = np.concatenate([[True], ends[:-1]]) if len(c) else ends
            low, high = again[first], again[ends]
            spread = mix(did[low].view(np.uint64) * _ODD[1] + alt[low].view(np.uint64) + pos[low].view(np.uint64) * _ODD[2])
            cols = (
                np.concatenate([h1[single], spread.view(np.int64)]),
                np.concatenate([h2[single], np.zeros(len(low), np.int32)]),
                np.concatenate([did[single], did[low]]),
                np.concatenate([alt[single], alt[low]]),
                np.concatenate([pos[single], pos[low]]).astype(np.int32),
                np.concatenate([pos[single], pos[high]]).astype(np.int32),
                np.concatenate([np.zeros(single.sum(), bool), np.ones(len(low), bool)]),
            )
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h1", "h2", "_did", "_alt", "lo", "hi", "known"])

        for batch in batches:
            dids, alts, ranges = _long(batch, "_did"), _long(batch, "_alt"), batch.column("ranges")
            ends = np.concatenate([[0], pc.list_value_length(ranges).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()])
            low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.flatten().flatten())
            for texts, of, before in _in_pieces(batch, window):
                for text, row, first in zip(texts, of.tolist(), before.tolist()):
                    if not text.is_valid:
                        continue
                    raw = text.as_buffer().to_pybytes()
                    n = len(raw.split()) - window + 1
                    marks = np.zeros(max(n, 0) + 1, np.int64)
                    lo, hi = (x[ends[row] : ends[row + 1]] - first for x in (low, high))
                    inside = (hi >= 0) & (lo < n)
                    np.add.at(marks, np.maximum(lo[inside], 0), 1)
                    np.add.at(marks, np.minimum(hi[inside], n - 1) + 1, -1)
                    at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                    if not len(at):
                        continue
                    held.append((*digests(raw, at, window), np.full(len(at), dids[row]), np.full(len(at), alts[row]), at + first))
                    rows += len(at)
                    if rows >= FLUSH:
                        yield out()
                        held, rows = [], 0
        if rows:
            yield out()

    return docs.select("_did", "_alt", "text", "ranges").mapInArrow(run, "h1 long, h2 int, _did long, _alt long, lo int, hi int, known boolean")


def repeated_windows(docs: DataFrame, ids: list[str], window: int, scratch: Scratch) -> DataFrame:
    """(_did, _alt, ranges): starts of the windows whose words also start earlier, as ranges (lo, hi), a row a document."""
    by_doc = lambda df: df.groupBy(*ids).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # noqa: E731 - within one document
    rows = _anchor_rows(docs, window).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    candidates = scratch.cut(by_doc(rows.where("known or n > 1")), "candidates")
    places = _window_rows(docs.join(candidates, ids), window)
    rank = F.rank().over(Window.partitionBy("h1", "h2").orderBy("_did", "_alt", "lo"))
    repeats = places.withColumn("rank", rank).where("known or rank > 1")
    found = scratch.cut(by_doc(repeats), "repeats")
    scratch.release(candidates)
    return found


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 20) -> DataFrame:
    """Adds n_words, n_removed and kept (the kept words joined by one space) to a table with doc_id and text.

    A word is removed if a window of `window` consecutive words that covers it has the same words as a window that
    starts earlier: in a document of smaller doc_id, or earlier in the same one. All windows are judged on the input.
    Null and empty texts have no words and keep nothing of none; texts shorter than a window keep all. A null doc_id
    comes before all others. Rows equal in doc_id and text are one document and get one result each; rows that share
    only the doc_id are ordered by a hash of their text. Very long texts are searched in pieces that overlap. Columns of the input stay, except those that have a result's
    name, which are replaced, and names that begin with an underscore, which are dropped. An empty table gives an
    empty one. What returns reads tables of `scratch`.
    """
    if window < 2 * REACH + GAP:
        raise ValueError(f"a window needs {2 * REACH + GAP} words at least")
    docs = docs.drop("n_words", "n_removed", "kept", *(c for c in docs.columns if c.startswith("_")))
    fields = docs.schema.fields
    names = docs.columns
    tagged, ids = _with_ids(docs)
    found = repeated_windows(tagged.select("_did", "_alt", "text"), ids, window, scratch)
    joined = tagged.join(found.withColumnRenamed("ranges", "_ranges"), ids, "left").drop(*ids)
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("_ranges").to_pylist()):
                    words = (text or "").encode().split()
                    n = len(words)
                    if ranges:
                        marks = np.zeros(n + 1, np.int64)
                        for r in ranges:
                            marks[r["lo"]] += 1
                            marks[min(r["hi"] + window, n)] -= 1
                        gone = np.cumsum(marks)[:n] > 0
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(b" ".join(words).decode())
                cols = [*(part.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_removed", "kept"])

    return joined.select(*names, "_ranges").mapInArrow(run, schema)


#: remove_repeats with windows of 20 words over the table `documents`, as the registered query returns it, for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), x AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS same FROM w, unnest(range(1, len(words) - 18)) AS t(pos)
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY same ORDER BY doc_id, pos) AS nth FROM x) WHERE nth > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r
), v AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), k AS (
  SELECT v.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY v.pos) FILTER (g.pos IS NULL) AS kept
  FROM v LEFT JOIN g ON v.doc_id = g.doc_id AND v.pos = g.pos GROUP BY v.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
