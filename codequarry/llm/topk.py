"""Exact top-k search by block-at-a-time pruning.

A vector's terms are its dimensions. Candidates are ordered by their dominant terms and cut into shards, these into
blocks of BLOCK rows; each block has the largest and smallest value of every term beside its forward index, a matrix.
The bound of a block for a query is the sum over terms of the query's weight times the maximum (for a negative weight,
the minimum). A query takes a shard's blocks by falling bound and scores them whole, until no bound reaches its k-th
best score.

Every query first searches the shard that it lies in itself, where its like are; that k-th score goes with it to all
other shards, so a shard without a block that can reach it costs a comparison of bounds. Shards stay where they are and
are held one at a time; queries stream past them in packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, SHARD, GROUP = 64, 16384, 2048
_MOST, _LONG = 1.7976931348623157e308, 2**63 - 1
_FOUND = "query_id long, row long, vec_id long, score long"


def quantize(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """Adds code: floor(scale * component) as whole doubles. Rows with a null id, a null vector, or a null or non-finite
    component are left out; a product beyond the range of doubles counts as its end. Other columns stay but embedding."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(F.col("_x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # floor() of a column gives longs; a double of 2**52 or more is whole already
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), y)))
    rows = vectors.withColumn("_x", x).where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull()).where(sound)
    return rows.withColumn("code", F.transform("_x", lambda v: whole(v * float(scale)))).drop("_x", "embedding")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Codes as rows, padded with zeros to the longest."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _bytes(codes: np.ndarray) -> tuple[int, bytes]:
    """Codes in as few bytes as they need: four each, or eight."""
    small = np.abs(codes).max(initial=0) < 2**31
    return 4 if small else 8, codes.astype(np.int32 if small else np.float64).tobytes()


def _codes(n: int, size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32 if size == 4 else np.float64).reshape(n, -1).astype(np.float64)


def scores(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs: by doubles where no sum can pass 2**53, else by integers of any
    size. Sums beyond a long's range count as its ends."""
    if not queries.size or not docs.size:
        return np.zeros((len(queries), len(docs)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(docs).max()) * queries.shape[1] < 2**53:
        return (queries @ docs.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries).astype(object) @ whole(docs).astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


class Shard:
    """Vectors in blocks, with each block's largest and smallest terms."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(codes, self.starts, axis=0), np.minimum.reduceat(codes, self.starts, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """An upper bound of each query's score in each block. Rounding may lower a sum of doubles by less than is added."""
        with np.errstate(over="ignore", invalid="ignore"):
            up = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
            size = np.abs(q) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
            return np.nan_to_num(up + size * 1e-9 + 1, nan=np.inf, posinf=np.inf)

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """(scores, ids) of each query's k best here, of those that aren't below its kth; how many blocks were scored.

        kth: a score that k candidates are known to reach, the least long where none is known."""
        width = max(q.shape[1], self.codes.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        if self.codes.shape[1] < width:
            wider = Shard(self.ids, np.pad(self.codes, ((0, 0), (0, width - self.codes.shape[1]))))
            self.codes, self.high, self.low = wider.codes, wider.high, wider.low
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth, scored = kth.copy(), 0
        none = np.iinfo(np.int64).min
        best = [(np.array([], np.int64), np.array([], np.int64))] * len(q)
        for step in range(len(self.starts)):
            block = order[:, step]
            # saturated scores may equal a bound's own end, so only what is known to be lower is left out
            open_ = np.flatnonzero((kth == none) | (bounds[np.arange(len(q)), block] >= kth))
            if not len(open_):
                break
            by_block = open_[np.argsort(block[open_], kind="stable")]
            for rows in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
                at = self.starts[block[rows[0]]]
                ids = self.ids[at : at + BLOCK]
                s = scores(q[rows], self.codes[at : at + BLOCK])
                scored += len(rows)
                hopeful = (s >= kth[rows, None]) & (ids[None, :] != q_ids[rows, None])
                for i in np.flatnonzero(hopeful.any(axis=1)):
                    r = rows[i]
                    all_s, all_id = np.concatenate([best[r][0], s[i, hopeful[i]]]), np.concatenate([best[r][1], ids[hopeful[i]]])
                    rank = np.lexsort((all_id, -all_s))[:k]
                    best[r] = all_s[rank], all_id[rank]
                    if len(rank) == k:
                        kth[r] = max(kth[r], all_s[rank[-1]])
        return best, scored


def _shards(codes: DataFrame, n: int) -> DataFrame:
    """(shard, first, ids, asks, size, data): shards of about SHARD vectors, in packs of as many at most; asks tells queries."""
    place = lambda f: F.coalesce(F.array_position("code", f("code")), F.lit(0))
    # the last key spreads rows that are equal in all else; the table below is written, so it is the same each time
    ordered = codes.withColumns({"high": place(F.array_max), "low": place(F.array_min), "nth": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(n, "high", "low", "vec_id", "nth").sortWithinPartitions("high", "low", "vec_id").select("vec_id", "asks", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        ids, asks, rows, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            size, data = _bytes(_stack(rows))
            row = [pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(asks).tobytes()], pa.binary()), pa.array([size], pa.int32()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["shard", "first", "ids", "asks", "size", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                b = batch.slice(at, SHARD)
                if held and held + b.num_rows > 2 * SHARD:
                    yield out()
                    first, ids, asks, rows, held = first + held, [], [], [], 0
                ids.append(b.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
                asks.append(b.column("asks").to_numpy(zero_copy_only=False).astype(np.int8))
                rows.append(_matrix(b.column("code")))
                held += b.num_rows
        if held:
            yield out()

    return ordered.mapInArrow(run, "shard long, first long, ids binary, asks binary, size int, data binary")


def _own(shards: DataFrame, k: int) -> DataFrame:
    """Queries in packs of GROUP (shard, first, n, ids, rows, kth, size, data), each with what its own pack of the shard
    holds for it (counts of found, found_ids, found_scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, asks = np.frombuffer(r["ids"], np.int64), np.flatnonzero(np.frombuffer(r["asks"], np.int8))
                if not len(asks):
                    continue
                shard = Shard(ids, _codes(len(ids), r["size"], r["data"]))
                for at in range(0, len(asks), GROUP):
                    own = asks[at : at + GROUP]
                    kth = np.full(len(own), np.iinfo(np.int64).min)
                    best, _ = shard.search(ids[own], shard.codes[own], kth, k)
                    for i, (s, _) in enumerate(best):
                        if len(s) == k:
                            kth[i] = s[-1]
                    size, data = _bytes(shard.codes[own])
                    counts = np.array([len(s) for s, _ in best], np.int64)
                    blobs = [ids[own], (r["shard"] << 32) + r["first"] + own, kth, counts, np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])]
                    row = [pa.array([r["shard"]], pa.int64()), pa.array([r["first"]], pa.int64()), pa.array([len(own)], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([size], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, ["shard", "first", "n", "ids", "rows", "kth", "counts", "found_ids", "found_scores", "size", "data"])

    return shards.mapInArrow(run, "shard long, first long, n int, ids binary, rows binary, kth binary, counts binary, found_ids binary, found_scores binary, size int, data binary")


def _listed(q_ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    cols = (np.repeat(q_ids, counts), np.repeat(rows, counts), ids, s)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "row", "vec_id", "score"])


def _seeds(packs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _listed(*(np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "counts", "found_ids", "found_scores")))

    return packs.select("ids", "rows", "counts", "found_ids", "found_scores").mapInArrow(run, _FOUND)


def _others(shards: DataFrame, packs: DataFrame, n: int, k: int) -> DataFrame:
    """What each pack of queries finds outside its own pack of its own shard."""
    null = lambda kind: F.lit(None).cast(kind)
    held = shards.select("shard", F.lit(0).alias("asking"), "first", null("long").alias("home"), null("long").alias("home_first"), F.lit(0).alias("n"), "ids", null("binary").alias("rows"), null("binary").alias("kth"), "size", "data")
    asked = packs.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("shard"), F.lit(1).alias("asking"), F.lit(0).cast("long").alias("first"), F.col("shard").alias("home"), F.col("first").alias("home_first"), "n", "ids", "rows", "kth", "size", "data")
    together = held.union(asked).repartition(n, "shard").sortWithinPartitions("shard", "asking", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []  # a shard has one pack, or more where many rows are equal in all their keys
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(r["ids"], np.int64)
                codes = _codes(len(ids), r["size"], r["data"])
                if r["shard"] != at:
                    at, parts = r["shard"], []
                if not r["asking"]:
                    parts.append((r["first"], Shard(ids, codes)))
                    continue
                rows, kth = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["kth"], np.int64)
                for first, shard in parts:
                    if (at, first) != (r["home"], r["home_first"]):
                        best, _ = shard.search(ids, codes, kth, k)
                        yield _listed(ids, rows, np.array([len(s) for s, _ in best], np.int64), np.concatenate([x for _, x in best]), np.concatenate([s for s, _ in best]))

    return together.mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, is_query, scratch: Scratch, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to smaller vec_id.

    vectors: vec_id and embedding; is_query: a Column on vec_id. Candidates are all rows but those of the query's own
    vec_id. Fewer candidates give fewer results; none, or an empty table, none. Vectors that quantize() leaves out take
    no part; a shorter vector counts as padded with zeros, so an empty one scores 0. Repeated rows are candidates each,
    and as queries repeat their results. Equal vectors tie and are ordered by id; ties between repeated rows of one id
    are equal rows. Further columns of any name are ignored. Scores beyond a long's range count as its ends. What
    returns reads tables of `scratch`.

    The vectors are read once. Queries, packed, go to every shard: what is shuffled is the queries times the shards.
    """
    asks = F.coalesce(is_query, F.lit(False)).cast("int").alias("asks")
    codes = scratch.cut(quantize(vectors.select("vec_id", "embedding"), scale).select(F.col("vec_id").cast("long").alias("vec_id"), asks, "code"), "codes")
    n = max(1, -(-codes.count() // SHARD))
    shards = scratch.cut(_shards(codes, n), "shards")
    packs = scratch.cut(_own(shards, k), "queries")
    found = _seeds(packs).union(_others(shards, packs, n, k))
    # at most k rows of each shard reach a query's window; `row` tells repeated rows of one id apart
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The registered search over the table `embeddings`, for DuckDB.
SQL = """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), t AS (
  SELECT vec_id, unnest(range(len(embedding))) AS term, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS code FROM e
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.code * c.code) AS BIGINT) AS score
  FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
