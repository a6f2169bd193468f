"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits is given a non-zero vector of radius + 1 bits; for every
non-zero v of that many bits there is a table whose mask keeps the bits with an
odd inner product with v. The vectors of the at most `radius` bits in which two
fingerprints differ span less than the whole space, so some v is orthogonal to
all of them and its mask hides every difference: each pair within the radius
meets in some table, whatever the data.

Fingerprints are made distinct first, so copies cost nothing further. A bucket
with more than HOT fingerprints is split by a second covering family over the
bits that its mask hides; what still meets there has about 16 free bits, so no
group exceeds 2**17 fingerprints. Within a group, links become one star for each
of its components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .graph import components

HOT = 4096
BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of a text's word shingles; A-Z lower-cased, fewer words: one shingle of all, none: 0."""
    words = (text or "").encode().lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        rows = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Adds `fp` (the 64 bits as a long) and drops `text`. Null text counts as empty: fp 0. Other columns stay, but
    for one named fp, which is replaced; repeated rows stay repeated; an empty table gives an empty one."""
    kept = docs.drop("fp")
    names = [c for c in kept.columns if c != "text"]
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != "text"), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values.view(np.int64))], [*names, "fp"])

    return kept.mapInArrow(run, schema)


def masks(radius: int, bits: list[int]) -> list[int]:
    """The covering family over the given bit positions: 2**(radius + 1) - 1 masks, as signed longs."""
    size = 2 ** (radius + 1)
    out = []
    for v in range(1, size):
        m = sum(1 << b for i, b in enumerate(bits) if ((1 + i % (size - 1)) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _keys(fps: DataFrame, radius: int) -> DataFrame:
    family = F.array(*map(F.lit, masks(radius, list(range(BITS)))))
    return fps.select("fp", F.posexplode(family).alias("t", "mask")).select(F.col("t").cast("int"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _split(hot: DataFrame, radius: int) -> DataFrame:
    """The rows of hot buckets under the second family, whose masks are those of the bits that the first one hides."""
    rows = []
    for m in masks(radius, list(range(BITS))):
        hidden = [b for b in range(BITS) if not m >> b & 1]
        rows.append(F.array(*(F.lit(x | m) for x in masks(radius, hidden))))
    finer: Column = F.element_at(F.array(*rows), F.col("t") + 1)
    out = hot.select("t", "fp", F.posexplode(finer).alias("s", "mask"))
    return out.select((1000 * (F.col("t") + 1) + F.col("s")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _stars(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of consecutive groups (starts: their first positions, then the end), as stars around each component's first."""
    n = len(fps)
    label = np.arange(n)
    sizes = np.diff(starts)
    group_end = np.repeat(starts[1:], sizes)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = label[a], label[b]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            open_ = low != high
            if not open_.any():
                return
            np.minimum.at(label, high[open_], low[open_])
            np.minimum(label, label[label], out=label)
            while (label != label[label]).any():
                label[:] = label[label]

    small = np.repeat(sizes <= 32, sizes)
    at, step = np.flatnonzero(small), 1
    while len(at := at[at + step < group_end[at]]):
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        unite(at[near], at[near] + step)
        step += 1
    for g in np.flatnonzero(sizes > 32):
        lo, hi = starts[g], starts[g + 1]
        block = max(1, 2_000_000 // (hi - lo))
        for i in range(lo, hi, block):
            rows = fps[i : min(i + block, hi), None]
            a, b = np.nonzero(np.bitwise_count(rows ^ fps[None, i:hi]) <= radius)
            unite(a + i, b + i)
    member = np.flatnonzero(label != np.arange(n))
    return fps[label[member]], fps[member]


def _links(keys: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) among the fingerprints of each (t, key). Groups stream by in order; only one is held beyond its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate([[0], change, [len(rows)]])
            sizes = np.diff(starts)
            several = np.repeat(sizes > 1, sizes)
            u, v = _stars(rows[several, 2].view(np.uint64), np.concatenate([[0], np.cumsum(sizes[sizes > 1])]), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "fp")], axis=1)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut or (held and (held[0][0, :2] != rows[0, :2]).any()):
                if cut:
                    yield out(np.concatenate([*held, rows[:cut]]))
                else:
                    yield out(np.concatenate(held))
                held = []
            held.append(rows[cut:])
        if held:
            yield out(np.concatenate(held))

    grouped = keys.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return grouped.mapInArrow(run, "u long, v long")


def link_fingerprints(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(node, root) of every fingerprint that has another within `radius` bits. fps: distinct non-null longs in `fp`."""
    keys = _keys(fps, radius)
    hot = scratch.cut(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("t", "key"), "hot")
    if not hot.isEmpty():
        # a hot bucket's rows are spread by adaptive skew handling here, and by their finer keys from here on
        keys = keys.join(hot, ["t", "key"], "left_anti").union(_split(keys.join(hot, ["t", "key"]), radius))
    edges = scratch.cut(_links(keys, radius).distinct(), "edges")
    scratch.release(hot)
    roots = components(edges, scratch)
    scratch.release(edges)
    return roots


def near_duplicates(docs: DataFrame, scratch: Scratch, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every document (docs: doc_id and text): its smallest reachable doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id is never a component's id
    unless all its members' are null. Repeated rows give repeated rows; ties don't arise, as ids are compared as
    they are. An empty table gives an empty one; other columns are left out. Very long texts are read whole, one at a
    time; their hashes take eight bytes a word. What returns reads tables of `scratch`.
    """
    found = scratch.cut(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    fps = scratch.cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    roots = link_fingerprints(fps.select("fp"), radius, scratch)
    linked = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    # written tables, not aggregates, on the small side of each join: only then can adaptive handling split a fingerprint
    # or a component that holds a third of all rows
    least = scratch.cut(linked.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    ids = scratch.cut(linked.join(least.hint("merge"), "root").select("fp", "component_id"), "component-ids")
    return found.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")
