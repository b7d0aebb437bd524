"""Hard negatives by exact search of inner products over one-dimensional distance keys.

One more component makes all vectors equally long, so that the largest inner product is
the least distance. Vectors are stored sorted by (pivot, distance to it), in shards of
neighbouring keys. A query's distance to a pivot bounds from below how near the vectors of
a key interval can be; its scan begins where its own key lies, widens to more shards each
round, and ends when no shard that is left can hold a score as high as those found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder

#: Pivots come from the rows of the SAMPLE least hashes, in ROUNDS of k-means.
PIVOTS, SAMPLE, ROUNDS = 32, 4096, 5
#: Rows of a shard: SHARD_ROWS, or more where that would make over MOST_SHARDS, up to MOST_SHARD_ROWS.
SHARD_ROWS, MOST_SHARDS, MOST_SHARD_ROWS = 4096, 1024, 1 << 20
#: Shards that a query meets in each round; the last takes all that are left.
WIDENING = (1, 8)
#: Scores that are held at a time.
CELLS = 1 << 22
#: Vectors of whole numbers stay shorter than the root of this, so that their inner products fit 63 bits.
LONGEST = 2.0**62
NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten())
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), int(size.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector of integers, norm2) of the rows that take part, relabelled."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    floors = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    length = F.aggregate(floors, F.lit(0.0), lambda s, x: s + x * x)
    # a component of a vector too long for 63 bits counts as no more than all of them could be at once
    most = F.when(length < LONGEST, 2.0**31 - 1).otherwise(F.least(F.lit(2.0**31 - 1), F.floor(F.sqrt(LONGEST / F.greatest(F.size(vector_col), F.lit(1)))).cast("double")))
    whole = F.transform(floors, lambda x: F.greatest(-most, F.least(most, x)).cast("int"))
    label = F.col(label_col).cast("long")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("vector"))
    norm2 = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return rows.withColumn("norm2", norm2)


def _pivots(rows: DataFrame, norm2: int) -> np.ndarray:
    """Means of a bounded sample of augmented vectors, dealt by hash and so the same in any order of rows."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector", "norm2").collect()
    width = max((len(r.vector) for r in found), default=0)
    points = np.array([[*r.vector, *[0] * (width - len(r.vector)), math.sqrt(norm2 - r.norm2)] for r in found])
    means = points[:: max(1, len(points) // PIVOTS)][:PIVOTS]
    for _ in range(ROUNDS):
        nearest = _distances(points, means).argmin(axis=1)
        means = np.array([points[nearest == k].mean(axis=0) if (nearest == k).any() else m for k, m in enumerate(means)])
    return means


def _distances(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (means**2).sum(axis=1) - 2 * points @ means.T
    return np.sqrt(np.maximum(square, 0))


def _augmented(vector: np.ndarray, norm2: np.ndarray, most: int | None, means: np.ndarray) -> np.ndarray:
    """Vectors of the pivots' width with the component that makes them equally long, 0 for queries."""
    last = np.zeros(len(vector)) if most is None else np.sqrt(np.maximum(most - norm2, 0))
    return np.column_stack([_wide(vector.astype(float), means.shape[1] - 1)[:, : means.shape[1] - 1], last])


def index(rows: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """(shards, pivots, bounds, longest): rows sorted by (pivot, distance) with their shard; a bound (shard, pivot, nearest, farthest) for each pivot of a shard."""
    n, longest, width = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.size("vector"))).first()
    if not n:
        return rows.withColumn("shard", F.lit(0)), np.zeros((0, 0)), np.zeros((0, 4)), 0
    means = _pivots(rows, longest)
    means = np.column_stack([_wide(means[:, :-1], width), means[:, -1]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_augmented(_matrix(batch.column("vector")), batch.column("norm2").to_numpy(), longest, means), means)
            nearest = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest])], names=[*batch.schema.names, "pivot", "distance"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(place, f"{kinds}, pivot int, distance double")
    shards = max(1, min(-(-n // SHARD_ROWS), MOST_SHARDS), -(-n // MOST_SHARD_ROWS))
    key = ["pivot", "distance", "vec_id", "row"]  # rows of one key are parted by their ids
    stored = keep(placed.repartitionByRange(shards, *key).sortWithinPartitions(*key).withColumn("shard", F.spark_partition_id()), folder)
    bounds = stored.groupBy("shard", "pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).orderBy("shard", "pivot").collect()
    return stored, means, np.array([tuple(b) for b in bounds], float), longest


def _ceilings(far: np.ndarray, norm2: np.ndarray, bounds: np.ndarray, longest: int) -> np.ndarray:
    """The highest score that each query can find in each shard, by its distances to the pivots; rows are queries."""
    pivot = bounds[:, 1].astype(int)
    gap = np.maximum(0, np.maximum(far[:, pivot] - bounds[:, 3], bounds[:, 2] - far[:, pivot]))
    # distances are square roots of differences: what rounding may take from a score is added
    most = (norm2[:, None] + longest - gap**2) / 2 + 1e-6 * (norm2[:, None] + longest) + 1
    shard = bounds[:, 0].astype(int)
    return np.maximum.reduceat(most, np.flatnonzero(np.diff(shard, prepend=-1)), axis=1)


def _measured(queries: DataFrame, means: np.ndarray) -> DataFrame:
    """queries with far, their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_augmented(_matrix(batch.column("vector")), batch.column("norm2").to_numpy(), None, means), means)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * len(means), pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(measure, f"{kinds}, far array<double>")


def _dealt(queries: DataFrame, bounds: np.ndarray, longest: int, seen: int, more: int | None) -> DataFrame:
    """queries with the next shards that each needs, in the order of what they could hold; those of the first ``seen`` ranks have been met.

    The order comes from written distances by single operations, so that it is the same in each round.
    """
    shards = np.unique(bounds[:, 0].astype(int))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), step := max(1, CELLS // max(1, len(bounds)))):
                rows = batch.slice(a, step)
                most = _ceilings(_matrix(rows.column("far")), rows.column("norm2").to_numpy(), bounds, longest)
                rank = np.argsort(-most, axis=1, kind="stable")
                part = rank[:, seen : len(shards) if more is None else seen + more]
                floor = rows.column("floor").to_numpy()
                need = np.take_along_axis(most, part, axis=1) >= floor[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(need.sum(axis=1)))), pa.int32()), pa.array(shards[part[need]], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "to"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(deal, f"{kinds}, to array<int>").withColumn("shard", F.explode("to")).drop("to")


def _product(a: np.ndarray, b: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products: in floats as far as they hold every partial sum, which Cauchy's inequality bounds by size."""
    if size < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if size < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _scan(k: int, same: bool, width: int):
    """Rows of a shard, then the queries that it is for: of each query's windows the k best rows of its label (same) or of others."""

    def best(query: dict, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, scores: np.ndarray, out: list) -> None:
        for q in range(len(scores)):
            fits = (labels == query["label"][q]) == same
            if same:
                fits &= rows != query["row"][q]
            for w, (low, high, floor) in enumerate(zip(query["low"][q], query["high"][q], query["floors"][q], strict=True)):
                at = np.flatnonzero(fits & (scores[q] >= max(low, floor)) & (scores[q] <= high))
                if len(at) > k:  # all that are as high as the k-th, then by id
                    at = at[scores[q][at] >= np.partition(scores[q][at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((rows[at], ids[at], -scores[q][at]))[:k]]
                for j in at:
                    out.append((query["row"][q], w, scores[q][j], ids[j], rows[j]))

    def batch_of(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["row", "window", "score", "hit_id", "hit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, data = None, [], None
        for batch in batches:
            of, asks = batch.column("shard").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != shard:
                    shard, held, data = of[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "vec_id", "label", "vector", "norm2")], names=["row", "vec_id", "label", "vector", "norm2"]))
                    continue
                if not held:
                    continue
                if data is None:
                    data = pa.Table.from_batches(held).combine_chunks()
                    vectors, ids, labels, rows = _wide(_matrix(data["vector"]), width), *(data[c].to_numpy() for c in ("vec_id", "label", "row"))
                    longest = math.sqrt(int(data["norm2"].to_numpy().max()))
                out: list = []
                for x in range(0, len(part), step := max(1, CELLS // len(ids))):
                    own = part.slice(x, step)
                    asked = _wide(_matrix(own.column("vector")), width)
                    size = longest * math.sqrt(int(own.column("norm2").to_numpy().max()))
                    query = {c: own.column(c).to_pylist() for c in ("row", "label", "low", "high", "floors")}
                    best(query, ids, labels, rows, _product(asked, vectors, size), out)
                yield batch_of(out)

    return run


def search(stored: DataFrame, means: np.ndarray, bounds: np.ndarray, longest: int, queries: DataFrame, k: int, same: bool, folder: str) -> DataFrame:
    """(row, window, rank, score, hit_id): for each window [low, high] of a query the k highest scores in it, exactly.

    queries: row, label, vector, norm2, low and high (arrays of longs, a window each).
    """
    width = means.shape[1] - 1
    blank = F.transform("low", lambda x: F.lit(int(NONE)).cast("long"))
    # floors: per window what a further hit must reach; floor: the least of them and of the windows
    asked = queries.select("row", "label", "vector", "norm2", "low", "high", blank.alias("floors"), F.array_min("low").alias("floor"))
    asked = keep(_measured(asked, means), folder)
    found, seen = None, 0
    for more in (*WIDENING, None):
        dealt = _dealt(asked, bounds, longest, seen, more)
        columns = ["shard", "ask", "row", "vec_id", "label", "vector", "norm2", "low", "high", "floors"]
        blanks = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high", "floors")]
        both = stored.select("shard", F.lit(False).alias("ask"), "row", "vec_id", "label", "vector", "norm2", *blanks).unionByName(
            dealt.select("shard", F.lit(True).alias("ask"), "row", F.lit(None).cast("long").alias("vec_id"), "label", "vector", "norm2", "low", "high", "floors")
        )
        tasks = max(1, len(np.unique(bounds[:, 0])))
        hits = both.select(*columns).repartition(tasks, "shard").sortWithinPartitions("shard", "ask").mapInArrow(_scan(k, same, width), "row long, window int, score long, hit_id long, hit long")
        if found is not None:
            hits = hits.unionByName(found.select("row", "window", "score", "hit_id", "hit"))
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "hit_id", "hit")
        found = keep(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), folder)
        seen += more or 0
        if more is None or seen >= tasks:
            break
        # a window with k hits asks for no less than the last of them, an equal score of a lesser id included
        full = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        floors = F.transform("low", lambda x, i: F.coalesce(F.element_at("kth", i.cast("int")), F.lit(int(NONE)).cast("long")))
        rows = asked.drop("floors", "floor").join(full, "row", "left").withColumn("floors", floors).drop("kth")
        need = F.array_min(F.zip_with("low", "floors", lambda a, b: F.greatest(a, b)))
        asked = keep(rows.withColumn("floor", need), folder)
    return found.select("row", "window", "rank", "score", "hit_id")


def hard_negatives(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, every: int = 50, least: int = 50, most: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly.

    Anchors are the rows whose id ``every`` divides, positives the best other rows of an
    anchor's label. A negative of another label scores from ``least`` to ``most`` per cent
    of the positive; a negative or zero positive score leaves no room, or that for zeros.
    Rows without an id, a label or a vector of numbers take no part; components of vectors
    whose squares sum to 2^62 or more count as the root of 2^62 over their number at most,
    shorter vectors end in zeros, and equal scores go by id.
    Repeated rows are rows of their own. No rows, or no rows of another label, give none.
    """
    folder = shared_folder(embeddings.sparkSession)
    rows = keep(usable(embeddings, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), folder)
    stored, means, bounds, longest = index(rows, folder)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not len(bounds):
        return embeddings.sparkSession.createDataFrame([], schema)
    anchors = keep(rows.where(F.col("vec_id") % every == 0), folder)
    whole = anchors.withColumn("low", F.array(F.lit(int(NONE) + 1))).withColumn("high", F.array(F.lit(int(-NONE - 1))))
    near = search(stored, means, bounds, longest, whole, positives, True, folder)
    # windows in the order of the positives; whole numbers, rounded inwards, hundreds apart so that no product leaves 63 bits
    windows = near.select("row", "rank", "score", "hit_id", F.expr(f"{least} * (score div 100) + ({least} * (score % 100) + 99) div 100").alias("l"), F.expr(f"{most} * (score div 100) + {most} * (score % 100) div 100").alias("h")).where("score >= 0")
    asked = windows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "l", "h", "hit_id", "score"))).alias("x"))
    asked = keep(asked.select("row", F.col("x.l").alias("low"), F.col("x.h").alias("high"), F.col("x.hit_id").alias("positive_id"), F.col("x.score").alias("positive_score")), folder)
    found = search(stored, means, bounds, longest, anchors.join(asked, "row"), negatives, False, folder)
    told = found.join(asked.select("row", F.posexplode(F.arrays_zip("positive_id", "positive_score")).alias("window", "p")), ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return told.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("hit_id").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
