"""Shortest-pack-first packing over the length histogram.

Documents become ids; every full sequence's worth is a sequence of its own, and the rest of each document is packed.
Packing works on the histogram of rests alone: lengths are placed longest first, each into the pack with the most room,
and what is counted is patterns, not documents; there are a few for each length, however many documents there are.
Packs that end up full are sequences. The others are laid end to end as one stream, cut at every sequence's length, so
nothing is padded; the stream's own end is cut at powers of two, which need no padding. Patterns return to the documents
by each rest's rank among those of its length: sequence and offset follow from it by arithmetic.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, text_slices

#: A word, or white space beyond one a word, of more characters than this goes to the codec's own merges.
LONG = 4096


@dataclass
class Pattern:
    """`count` packs alike. parts: (length of the rest, first rank of those that lie here in each pack)."""

    count: int
    parts: list[tuple[int, int]] = field(default_factory=list)
    fill: int = 0

    def split(self, n: int) -> Pattern:
        """Takes n packs off the front."""
        front = Pattern(n, list(self.parts), self.fill)
        self.count -= n
        self.parts = [(length, rank + n) for length, rank in self.parts]
        return front


def plan(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns of packs of at most `size` that hold every rest of the histogram (length: count; lengths from 1 to size).

    A length opens at most one pattern and splits at most one, so there are at most two for each length."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # a heap of rooms, widest first; some may be empty by now

    def put(p: Pattern) -> None:
        held = by_room.setdefault(size - p.fill, [])
        if not held:
            heapq.heappush(rooms, p.fill - size)
        held.append(p)

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        rank, left, touched = 0, histogram[length], []
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                if touched:  # the packs just added to may have the most room
                    for p in touched:
                        put(p)
                    touched = []
                    continue
                pattern, n = Pattern(left), left
            else:
                pattern = by_room[-rooms[0]].pop()
                n = min(pattern.count, left)
                if n < pattern.count:
                    rest = pattern
                    pattern = rest.split(n)
                    put(rest)
            pattern.parts.append((length, rank))
            pattern.fill += length
            touched.append(pattern)
            rank, left = rank + n, left - n
        for p in touched:
            put(p)
    return [p for ps in by_room.values() for p in ps]


@dataclass
class Layout:
    """Where the rest of each length and rank lies. places: for each length, first ranks of its parts and, beside them,
    rows (first rank, position of that one, step from rank to rank). Positions count ids over all sequences, full
    packs first; from `whole` on, sequences end at `ends`."""

    size: int
    places: dict[int, tuple[np.ndarray, np.ndarray]]
    whole: int
    ends: list[int]

    @property
    def sequences(self) -> int:
        return self.whole // self.size + len(self.ends)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the rest, length, sequence, offset) of one rest."""
        firsts, rows = self.places[length]
        r0, at, step = rows[np.searchsorted(firsts, rank, "right") - 1].tolist()
        at += (rank - r0) * step
        out, start = [], 0
        while start < length:
            if at < self.whole:
                sequence, offset = divmod(at, self.size)
                end = at - offset + self.size
            else:
                i = bisect.bisect_right(self.ends, at)
                end, sequence = self.ends[i], self.whole // self.size + i
                offset = at - (self.ends[i - 1] if i else self.whole)
            n = min(length - start, end - at)
            out.append((start, n, sequence, offset))
            start, at = start + n, at + n
        return out


def layout(patterns: list[Pattern], size: int) -> Layout:
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    # full packs are the stream's start: they are as long as a sequence, so no cut falls within one
    for p in sorted(patterns, key=lambda p: -p.fill):
        offset = 0
        for length, rank in p.parts:
            rows.setdefault(length, []).append((rank, at + offset, p.fill))
            offset += length
        at += p.count * p.fill
    whole, ends = at // size * size, []
    done = whole
    while done < at:
        done += 1 << ((at - done).bit_length() - 1)
        ends.append(done)
    places = {length: np.array(sorted(r), np.int64) for length, r in rows.items()}
    return Layout(size, {length: (r[:, 0].copy(), r) for length, r in places.items()}, whole, ends)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """From a text to its ids as unsigned 32-bit integers, as the tokenizers library gives them.

    Where ids follow the merges, the rank-file library reads the same vocabulary and merges by it in compiled code; for
    other files, and for texts with stretches that are costly for it (one word or one run of white space of thousands
    of characters), it is the codec's own merges.
    """
    codec = bpe.codec(path)
    if codec.lowers or not all(codec.vocab.get(a + b) == rank + 256 for (a, b), rank in codec.ranks.items()):
        return codec.encode
    import public_tokenizers
    import tiktoken

    plain = {v: k for k, v in codec.raw.items() if codec.strings[k] not in codec.special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens=codec.special)

    def encode(text: str) -> np.ndarray:
        words = text.split()
        longest, chars = max(map(len, words), default=0), sum(map(len, words))
        if longest > LONG or len(text) - chars - len(words) > LONG:
            return codec.encode(text)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def tokens(docs: DataFrame, path: str, size: int, end: int = 0) -> DataFrame:
    """Rows (doc_id, doc_tokens, full_crcs, rest, rest_ids): ids of each document and `end`; the CRC-32 of each full
    sequence's worth; the length of the rest, 0 if none, and its ids, two bytes each if they all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.array([end], "<u4")
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, crcs, rests, blobs = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = np.concatenate([encode(text or ""), last])
                    whole = len(ids) // size * size
                    n.append(len(ids))
                    crcs.append([zlib.crc32(ids[i : i + size].tobytes()) for i in range(0, whole, size)])
                    rests.append(len(ids) - whole)
                    rest = ids[whole:]
                    blobs.append(rest.astype("<u2").tobytes() if rest.max(initial=0) < 65536 else rest.tobytes())
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.int32()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc_tokens", "full_crcs", "rest", "rest_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, full_crcs array<long>, rest int, rest_ids binary")


def pack(docs: DataFrame, path: str, scratch: Scratch, size: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each document.

    docs: doc_id and text; further columns are ignored. Each document's ids, then `end`, lie in pieces without gap or
    overlap, and pieces in sequences of at most `size`. Sequence ids count from 0 without gaps: packs first, then full
    sequences. Null and empty texts have the one id `end`. Rows are packed one by one, so repeated rows, rows that
    share an id and rows without one are packed each; which of them gets which place is arbitrary. An empty table
    gives an empty one. What returns reads a table of `scratch`.
    """
    spark = docs.sparkSession
    rows = scratch.cut(tokens(docs, path, size, end), "tokens")
    # a length that a third of all rows share is spread over buckets; ranks count on from bucket to bucket
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest_ids"), F.lit(buckets)).cast("int"))
    sizes = scratch.cut(rows.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full")), "lengths")
    lengths = sizes.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).orderBy("rest").collect()  # at most `size` rows
    found = layout(plan({r["rest"]: r["n"] for r in lengths if r["rest"]}, size), size)
    first_full, at = {}, found.sequences
    for r in lengths:
        first_full[r["rest"]] = at
        at += r["full"]

    # ranks among a length go from bucket to bucket; the sums are over one row for each bucket
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("rest", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full0"))
    within = Window.partitionBy("rest", "bucket").orderBy("doc_id", "doc_tokens", "rest_ids")
    ranked = rows.withColumns({"rank": F.row_number().over(within) - 1, "full": F.sum(F.size("full_crcs")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.size("full_crcs")})
    ranked = ranked.join(base.hint("merge"), ["rest", "bucket"]).withColumns({"rank": F.col("rank") + F.col("rank0"), "full": F.col("full") + F.col("full0")})
    ranked = ranked.select("doc_id", "doc_tokens", "full_crcs", "rest", "rest_ids", "rank", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, crcs, rest, blob, rank, full in zip(*(batch.column(i).to_pylist() for i in range(7))):
                full += first_full[rest]
                out += [(doc, i * size, size, crc, n, full + i, 0) for i, crc in enumerate(crcs)]
                if rest:
                    ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * rest else "<u4").astype("<u4")
                    for start, used, seq, offset in found.pieces(rest, rank):
                        out.append((doc, len(crcs) * size + start, used, zlib.crc32(ids[start : start + used].tobytes()), n, seq, offset))
            columns = zip(*out) if out else [[]] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _NAMES[1:]))


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
