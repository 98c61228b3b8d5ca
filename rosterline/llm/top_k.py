"""Exact top-k by integer inner product, selecting each query's k-th score from score histograms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import new_folder, staged
from rosterline.session import path_exists

K = 5
QUERY_BLOCK = 4096  # vectors sent to the tasks at a time; with 64 components that is 2 MB
CANDIDATE_BLOCK = 512
LOWEST = np.iinfo(np.int64).min
BIN_BITS = 9
BINS = 1 << BIN_BITS  # per query and round; counts of a block are 16 MB


def whole_vectors(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id and v, the components times the scale, rounded down; rows that take no part are left out.

    Left out are null ids, null or empty vectors, and vectors with a null or non-finite component.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.col(id_column).isNotNull() & (F.size(vector) > 0) & finite
    return rows.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("v"))


def _blocks(batch: pa.RecordBatch):
    """(ids, matrix) of at most CANDIDATE_BLOCK vectors of one length."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lists = batch.column("v")
    lengths = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        chosen = np.flatnonzero(lengths == length)
        for at in range(0, len(chosen), CANDIDATE_BLOCK):
            part = chosen[at : at + CANDIDATE_BLOCK]
            yield ids[part], flat[starts[part][:, None] + np.arange(length)]


def _scores(query_ids, queries, ids, matrix) -> np.ndarray:
    """Inner products; LOWEST where query and candidate are the same row. Exact: sums beyond 2**53 use integers."""
    bound = float(np.abs(queries).max()) * float(np.abs(matrix).max()) * matrix.shape[1]
    if bound < 2**53:
        scores = (queries.astype(np.float64) @ matrix.astype(np.float64).T).astype(np.int64)
    else:
        scores = queries.astype(np.int64) @ matrix.astype(np.int64).T
    scores[query_ids[:, None] == ids[None, :]] = LOWEST
    return scores


def _query_groups(queries):
    """Per length of vector: ids, matrix, and the place of each query in the block."""
    by_length: dict[int, list] = {}
    for place, (vec_id, vector) in enumerate(queries):
        by_length.setdefault(len(vector), []).append((place, vec_id, vector))
    return {
        n: tuple(np.array([row[x] for row in rows]) for x in (1, 2, 0)) for n, rows in by_length.items()
    }


def _histograms(sent, ranges, k):
    """Count every score of one task per query and bin.

    ``ranges`` has, per query of the block, where its bins start, how wide they are, as a power of two, or a width below 0
    for a query whose k-th score is known, and how many there are. Of the counts, those above and up to the bin with which this task
    alone has k scores are sent: no lower bin holds the k-th score of the whole table.
    """

    def run(batches):
        groups = _query_groups(sent.value)
        low, shift, high = ranges.value
        counts = {n: np.zeros(len(ids) * BINS, dtype=np.int64) for n, (ids, _, _) in groups.items()}
        for batch in batches:
            for ids, matrix in _blocks(batch):
                if matrix.shape[1] not in groups:
                    continue
                query_ids, queries, places = groups[matrix.shape[1]]
                scores = _scores(query_ids, queries, ids, matrix)
                bins = (scores - low[places][:, None]) >> np.maximum(shift[places], 0)[:, None]
                inside = (scores >= low[places][:, None]) & (bins < high[places][:, None]) & (scores != LOWEST) & (shift[places] >= 0)[:, None]
                bins += (np.arange(len(query_ids)) * BINS)[:, None]
                counts[matrix.shape[1]] += np.bincount(bins[inside], minlength=len(query_ids) * BINS)
        for n, (query_ids, _, places) in groups.items():
            table = counts[n].reshape(-1, BINS)
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            at, column = np.nonzero((table > 0) & (above < k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[at].astype(np.int64)), pa.array(column.astype(np.int64)), pa.array(table[at, column])],
                names=["place", "bin", "n"],
            )

    return run


def _winners(sent, limits, k):
    """The rows of one task that reach their query's k-th score; of ties only as many as could be needed."""

    def run(batches):
        groups = _query_groups(sent.value)
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for ids, matrix in _blocks(batch):
                if matrix.shape[1] not in groups:
                    continue
                query_ids, queries, places = groups[matrix.shape[1]]
                scores = _scores(query_ids, queries, ids, matrix)
                least = np.maximum(limits.value[places], LOWEST + 1)
                at, column = np.nonzero(scores >= least[:, None])
                rows = np.stack([query_ids[at], scores[at, column], ids[column]], axis=1)
                if matrix.shape[1] in best:
                    rows = np.concatenate([best[matrix.shape[1]], rows])
                rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
                first = np.searchsorted(rows[:, 0], rows[:, 0])
                best[matrix.shape[1]] = rows[np.arange(len(rows)) - first < k]
        for rows in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, x]) for x in range(3)], names=["query_id", "score", "vec_id"])

    return run


def _first_ranges(queries, norms: dict[int, float]):
    """Per query the least score that can be, and how wide its bins must be: no score is beyond the norms' product."""
    low, shift = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
    for place, (_, vector) in enumerate(queries):
        reach = math.isqrt(sum(x * x for x in vector)) + 1
        most = min(reach * (math.ceil(norms[len(vector)]) + 1), 1 << 61)
        low[place], shift[place] = -most, max(0, (2 * most).bit_length() - BIN_BITS)
    return low, shift


def _kth_scores(vectors: DataFrame, sent, queries, norms: dict[int, float], k: int) -> np.ndarray:
    """The k-th best score of each query of the block, or LOWEST where it has fewer candidates than k.

    A round counts all scores in BINS bins per query, over all tasks, and goes on in the bin that holds the k-th, until
    that bin is one score wide.
    """
    spark = vectors.sparkSession
    low, shift = _first_ranges(queries, norms)
    need, limits, high = np.full(len(queries), k), np.full(len(queries), LOWEST), np.full(len(queries), BINS)
    while (shift >= 0).any():
        ranges = spark.sparkContext.broadcast((low, shift, high))
        counted = vectors.mapInArrow(_histograms(sent, ranges, k), "place long, bin long, n long")
        counted = counted.groupBy("place", "bin").agg(F.sum("n").alias("n"))
        wanted = spark.createDataFrame(list(enumerate(need.tolist())), "place long, need long")  # QUERY_BLOCK rows
        down = Window.partitionBy("place").orderBy(F.desc("bin"))
        upto = counted.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(wanted), "place")
        hit = F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))))
        found = {row["place"]: row["hit"] for row in upto.groupBy("place").agg(hit.alias("hit")).collect()}
        ranges.unpersist()
        for place in np.flatnonzero(shift >= 0):
            if not found.get(place):
                shift[place] = -1  # fewer than k candidates: every score counts
                continue
            low[place] += found[place]["bin"] << int(shift[place])
            need[place] -= found[place]["above"]
            if shift[place] == 0:
                limits[place], shift[place] = low[place], -1
            else:
                high[place] = 1 << min(BIN_BITS, int(shift[place]))
                shift[place] = max(0, shift[place] - BIN_BITS)
    return limits


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, ties to the smaller id.

    ``vectors`` comes from ``whole_vectors``. Queries go to the tasks in blocks of fixed size; each round scores
    every row against a block and counts all scores per query, first in wide bins over all that the vectors' norms allow,
    then in the bin that holds the k-th score, until that score itself is known. Then rows that reach it are fetched.
    Each block's rows are written to one folder, which is read once.
    A query has every row but those with its own id as candidates, and of its length only; rows that repeat an
    id are separate candidates, and the query is asked once, with the least of their vectors.
    No rows or no queries give no rows; other columns are not looked at; vectors may be of any length.
    """
    spark = vectors.sparkSession
    vectors = staged(vectors, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    norms = {row["n"]: row["norm"] for row in vectors.groupBy(F.size("v").alias("n")).agg(F.sqrt(F.max(squares)).alias("norm")).collect()}
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = staged(queries, "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # Files hold ranges of blocks, so that reading one block passes over most of them.
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    numbered = staged(numbered.repartitionByRange("block").sortWithinPartitions("block"), "blocks")
    results = new_folder(spark, "top")
    for block in range(blocks):
        some = [(row["vec_id"], row["v"]) for row in numbered.filter(F.col("block") == block).collect()]
        if not some:
            continue
        sent = spark.sparkContext.broadcast(some)
        limits = spark.sparkContext.broadcast(_kth_scores(vectors, sent, some, norms, k))
        best = vectors.mapInArrow(_winners(sent, limits, k), "query_id long, score long, vec_id long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(results)
        for each in (sent, limits):
            each.unpersist()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(results) if path_exists(spark, results) else spark.createDataFrame([], schema)
