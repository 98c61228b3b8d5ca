"""Exact k-means on whole-number vectors, with bounds loosened by total displacement since they were taken."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rosterline.llm.common import staged_at
from rosterline.session import remove_path

STATE = "cluster int, former int, upper double, lower double, round int, rescans int"
BLOCK = 4096  # vectors whose distances to all centroids are in memory at once
LOOSE = 1e-9  # covers the rounding of roots and sums, which is far less


def whole_vectors(rows: DataFrame, length: int, scale: int, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id and v, the components times the scale, rounded down, of the rows that take part.

    Left out are null vectors, those of another length and those with a null or non-finite component.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.filter((F.size(vector) == length) & finite).select(F.col(id_column).alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least SHA-256 of ``seed:vec_id``, in that order; a null id counts as ``null``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(row["v"]) for row in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors: by floats while all sums fit, else by integers."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(centroids).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def displacement(history: np.ndarray) -> np.ndarray:
    """[t, j]: how far centroid j lies now from where it was in round t, rounded up. The last round is now."""
    return np.sqrt(((history - history[-1]) ** 2).sum(2).astype(np.float64)) * (1 + LOOSE)


def assign(x: np.ndarray, state: dict[str, np.ndarray] | None, history: np.ndarray) -> dict[str, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, by the last round of the history.

    ``upper`` and ``lower`` are the distances, in round ``round``, to the vector's centroid and to the nearest other one.
    The triangle inequality bounds today's distances by the norm of what a centroid has moved in all since that
    round: this is never more than the sum of its moves, and is nothing if it came back. Where the upper bound is not
    below the lower one, the vector is scanned again against all centroids, exactly, and has new bounds of this round.
    """
    now = len(history) - 1
    if state is None:
        n = len(x)
        state = {"cluster": np.zeros(n, np.int32), "upper": np.zeros(n), "lower": np.zeros(n), "round": np.zeros(n, np.int32), "rescans": np.zeros(n, np.int32)}
        failed = np.ones(n, dtype=bool)
    else:
        moved = displacement(history)
        cluster, seen = state["cluster"], state["round"]
        others = np.empty_like(moved)  # the most that any other centroid has moved
        for j in range(moved.shape[1]):
            others[:, j] = np.delete(moved, j, axis=1).max(axis=1, initial=0)
        failed = state["upper"] + moved[seen, cluster] >= state["lower"] - others[seen, cluster]
    out = {name: values.copy() for name, values in state.items()}
    out["former"] = state["cluster"].copy()
    again = np.flatnonzero(failed)
    for at in range(0, len(again), BLOCK):
        rows = again[at : at + BLOCK]
        squares = squared_distances(x[rows], history[-1])
        best = squares.argmin(axis=1)
        nearest = squares[np.arange(len(rows)), best]
        rest = squares.astype(np.float64)
        rest[np.arange(len(rows)), best] = np.inf
        out["cluster"][rows] = best
        out["upper"][rows] = np.sqrt(nearest.astype(np.float64)) * (1 + LOOSE)
        out["lower"][rows] = np.sqrt(rest.min(axis=1)) * (1 - LOOSE)
        out["round"][rows] = now
    out["rescans"] = out["rescans"] + failed
    return out


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _assigned(rows: DataFrame, history: np.ndarray, started: bool) -> DataFrame:
    """The rows with their state by the last centroids of the history."""
    names = [part.split()[0] for part in STATE.split(", ")]
    id_type = rows.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {id_type}, v array<bigint>, {STATE}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    sent = rows.sparkSession.sparkContext.broadcast(history)  # rounds x k x components numbers, whatever the table's size

    def run(batches):
        past = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            state = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in names if name != "former"} if started else None
            out = assign(_matrix(batch, past.shape[2]), state, past)
            arrays = [pa.array(out[name], schema.field(name).type) for name in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), batch.column("v").cast(schema.field(1).type), *arrays], schema=schema)

    return rows.mapInArrow(run, ddl)


def _sums(rows: DataFrame, k: int, length: int, only_moved: bool) -> tuple[np.ndarray, np.ndarray]:
    """(count, component sums) per cluster; of moved rows only, what each cluster gains less what it loses."""
    ddl = "cluster int, size bigint, total array<bigint>"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    def add(batches):
        size, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            x = _matrix(batch, length)
            for name, sign in (("cluster", 1), ("former", -1)) if only_moved else (("cluster", 1),):
                to = batch.column(name).to_numpy()
                np.add.at(size, to, sign)
                np.add.at(total, to, sign * x)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(size), pa.array(total.tolist(), schema.field(2).type)], schema=schema)

    chosen = rows.filter("cluster <> former") if only_moved else rows
    parts = chosen.select("v", "cluster", "former").mapInArrow(add, ddl)  # k rows a task
    at = parts.select("cluster", F.posexplode(F.concat(F.array("size"), "total")).alias("at", "value"))
    sums = at.groupBy("cluster", "at").agg(F.sum("value").alias("value"))
    out = np.zeros((k, length + 1), np.int64)
    for row in sums.collect():  # k x (components + 1) numbers
        out[row["cluster"], row["at"]] = row["value"]
    return out[:, 0], out[:, 1:]


def clusters(vectors: DataFrame, k: int, rounds: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster, distance and rescans of every vector, and the final centroids, after so many rounds.

    Every round assigns each vector to its nearest centroid, ties to the smaller number, and replaces the centroids
    that have vectors by the means of theirs, each component rounded down; one more assignment follows. Each
    assignment is written with its bounds (see ``assign``); the next one reads it and scans again only where the
    bounds fail, and the sums of a cluster change by the vectors that moved. The folder before is then removed. Rows
    that repeat an id are vectors of their own; with fewer than k vectors each is a centroid; an empty table gives
    no rows. Other columns are not looked at. All vectors have one length (see ``whole_vectors``).
    """
    start = first_centroids(vectors, k, seed)
    if not start:
        empty = vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "rescans": F.lit(0)})
        return empty, np.zeros((0, 0), np.int64)
    history = np.array([start], dtype=np.int64)
    k, length = history.shape[1:]
    rows, path = vectors, None
    count, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
    for turn in range(rounds + 1):
        former = path
        rows, path = staged_at(_assigned(rows, history, turn > 0), "assigned")
        if former:
            remove_path(vectors.sparkSession, former)
        if turn < rounds:
            more, gain = _sums(rows, k, length, turn > 0)
            count, total = count + more, total + gain
            means = total // np.maximum(count, 1)[:, None]
            history = np.concatenate([history, np.where(count[:, None] > 0, means, history[-1])[None]])
    last = history[-1]
    number = F.col("cluster") + 1
    centroid = F.element_at(F.array(*[F.array(*[F.lit(int(c)) for c in each]) for each in last]), number)
    distance = F.aggregate(F.zip_with("v", centroid, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("vec_id", "v", "cluster", distance.alias("distance"), "rescans"), last


def clustering(vectors: DataFrame, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """``clusters`` per vector with cluster_inertia, inertia and the hash of its centroid."""
    found, centroids = clusters(vectors, k, rounds, seed)
    sums = {row["cluster"]: row["sum"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, each)).encode()).hexdigest() for each in centroids.tolist()]
    totals = [(number, sums.get(number, 0), sum(sums.values()), digest) for number, digest in enumerate(hashes)]  # k rows
    named = found.sparkSession.createDataFrame(totals, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "rescans"
    )
