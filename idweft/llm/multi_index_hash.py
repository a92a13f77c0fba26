"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then alternating rotation to the
nearest corners); the signs of the rotated coordinates are a vector's code. A code is split
into substrings, each with its own index of the rows by value. By the pigeonhole principle a
code within the radius of a query's is within a share of it in some substring, so probing
those values finds every such code. Codes found are filtered by full Hamming distance, and
the rest are ranked by inner products of the original vectors in double precision.

The rows are dealt into shards of bounded size. A task holds one shard at a time with its
indexes, and the queries stream through it; it keeps the nearest of each query. Vectors of
candidates are copied only where there are fewer shards than tasks: then the queries are
dealt into blocks so that all tasks have work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the rotation and the radius are fit on at most, and queries that the radius is.
SAMPLE, SAMPLE_QUERIES = 8_192, 256
#: The radius reaches this share of the true neighbours in the sample, where they lie further
#: apart than among all rows, so recall over all rows is higher.
REACH = 0.985
SUBSTRING_BITS = 8
#: Bytes of vectors in double precision that a shard holds.
SHARD_BYTES = 1 << 26
SEED = 11


class Codes:
    """The learned mean and rotation; codes are rows of bytes, one byte a substring."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 25):
        rng = np.random.default_rng(SEED)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        if bits <= sample.shape[1]:
            axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
        else:
            axes = rng.normal(size=(sample.shape[1], bits)) / math.sqrt(bits)
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        flat = centred @ axes
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.axes = axes @ turn

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.axes > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal sums wherever they stand."""
    return (vectors * query).sum(axis=1)


def fit_radius(codes: Codes, sample: np.ndarray, k: int, reach: float = REACH) -> int:
    """The Hamming radius that reaches ``reach`` of the nearest ``k`` in the sample."""
    if len(sample) < 2:
        return 0
    own = codes.of(sample)
    found = []
    for i in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        near = products(sample, sample[i])
        near[i] = -np.inf
        found.append(distances(own[np.argsort(-near)[: min(k, len(sample) - 1)]], own[i]))
    return int(np.quantile(np.concatenate(found), reach, method="higher"))


def probe_radii(radius: int, parts: int) -> list[int]:
    """Radius of each substring: if all were exceeded, the codes would differ by more than ``radius``."""
    each, more = divmod(radius + 1, parts)
    return [each] * more + [each - 1] * (parts - more)  # the (r_i + 1) add up to radius + 1


class Shard:
    """A shard's vectors, codes and the index of each substring."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes.of(vectors)
        self.order = np.argsort(self.codes, axis=0, kind="stable").T
        self.begin = np.stack([np.searchsorted(self.codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a code within ``radius``, by probing the substrings' indexes."""
        values = np.arange(256, dtype=np.uint8)
        seen = np.zeros(len(self.ids), bool)
        for j, reach in enumerate(probe_radii(radius, len(code))):
            if reach >= 0:
                for value in np.flatnonzero(np.bitwise_count(values ^ code[j]) <= reach):
                    seen[self.order[j, self.begin[j, value] : self.begin[j, value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.codes[rows], code) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` ids and scores; the radius grows until it holds ``k`` rows or all."""
        bits = 8 * len(code)
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(2, bits // 16))
        scores = products(self.vectors[rows], query)
        if len(rows) > k:  # all that tie with the last stay for the ids to decide
            last = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= last], scores[scores >= last]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def usable(vector: Column) -> Column:
    """Whether a vector has no null or non-finite component and is not zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _meet(model, width: int, k: int):
    """The nearest of each query in each shard, from rows sorted by tile, candidates first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, radius = model.value
        tile, held, shard = None, [], None
        for batch in batches:
            tiles, asks = batch.column("tile").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, values = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, width)
            kind = 2 * tiles + asks
            ends = [*(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
            begin = 0
            for end in ends:
                if begin == end:
                    continue
                if tiles[begin] != tile:
                    tile, held, shard = tiles[begin], [], None
                part = slice(begin, end)
                begin = end
                if not asks[part.start]:
                    held.append((ids[part].copy(), values[part].copy()))
                    continue
                if shard is None and held:
                    shard, held = Shard(*map(np.concatenate, zip(*held, strict=True)), codes), []
                if shard is not None:
                    yield nearest(shard, ids[part], values[part], codes, radius)

    def nearest(shard: Shard, ids, values, codes, radius) -> pa.RecordBatch:
        found = [shard.nearest(i, v, code, radius, k) for i, v, code in zip(ids.tolist(), values, codes.of(values), strict=True)]
        query_ids = np.repeat(ids, [len(near) for near, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(np.concatenate([near for near, _ in found])), pa.array(np.concatenate([scores for _, scores in found]))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every ``every``-th id.

    Nearness is the largest inner product in double precision; ties go to the smaller id, and
    ranks begin at 1. Fewer rows than ``k`` are returned only where there are fewer
    candidates. Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows with a null id or of another length than most of the sample. A row with
    the query's own id is no candidate; repeated ids are candidates each, and rows of one
    query id ask once (the row whose vector hashes lowest). Other columns are left out; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()["v"].tolist()  # bounded
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = np.array([len(v) for v in sample])
    width = int(np.bincount(sizes).argmax())
    sample = np.array([v for v in sample if len(v) == width], np.float64)
    bits = bits or max(SUBSTRING_BITS, width // SUBSTRING_BITS * SUBSTRING_BITS)
    codes = Codes(sample, bits)
    model = spark.sparkContext.broadcast((codes, fit_radius(codes, sample, k)))
    rows = rows.filter(F.size("v") == width)
    shards = max(1, math.ceil(rows.count() * 8 * width / shard_bytes))
    blocks = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    # the seed alone places a row, so that many rows of one id don't meet in one shard
    base = rows.select("id", "v", F.floor(F.rand(SEED) * shards).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = queries.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"))
    tiles = base.unionByName(asked).select("id", "v", (F.col("shard") * blocks + F.col("block")).alias("tile"), "asks")
    dealt = tiles.repartition(min(shards * blocks, 1 << 17), "tile").sortWithinPartitions("tile", "asks")
    found = dealt.mapInArrow(_meet(model, width, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, every: int = 20, k: int = 20) -> float:
    """Share of the true nearest among ``found``, on tables small enough for one process."""
    table = vectors.select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, values = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    got = {(r["query_id"], r["vec_id"]) for r in found.select("query_id", "vec_id").collect()}
    hit = total = 0
    for i in np.flatnonzero(ids % every == 0):
        near = products(values, values[i])
        near[i] = -np.inf
        true = ids[np.lexsort((ids, -near))[: min(k, len(ids) - 1)]]
        hit += sum((ids[i], j) in got for j in true)
        total += len(true)
    return hit / max(1, total)


