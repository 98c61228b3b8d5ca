"""A linear toxicity classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import staged
from rosterline.llm.preference import bounded, held_out, training_rows

BITS = 22  # n-grams are counted in 2**BITS slots
SIZES = (3, 4, 5, 6)
SAMPLE_ROWS = 5_000  # labelled rows per label that the fit may use
FEATURES = 4096  # slots that tell the labels apart best and so have a weight
LEAST_DOCUMENTS = 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def ngram_slots(text: str | None):
    """Per size the slot of every character n-gram of the whole text, white space counting as one space."""
    joined = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    rolled = np.zeros(len(codes) + 1, dtype=np.uint64)[: len(codes)]
    for size in range(1, max(SIZES) + 1):
        if len(codes) < size:
            return
        rolled = (rolled[: len(codes) - size + 1] + codes[size - 1 :] + np.uint64(1)) * _PRIME
        rolled ^= rolled >> np.uint64(29)
        if size in SIZES:
            yield (rolled * _PRIME) >> np.uint64(64 - BITS)


def present(text: str | None, place: np.ndarray) -> np.ndarray:
    """The features among the text's n-grams, each once; ``place`` has a slot's feature, or -1."""
    found = [place[slots] for slots in ngram_slots(text)]
    found = np.concatenate([each[each >= 0] for each in found]) if found else np.zeros(0, np.int16)
    return np.unique(found)


def places(chosen: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int16)
    place[chosen] = np.arange(len(chosen))
    return place


def length_scale(ratios: np.ndarray) -> float:
    """What a document's features are multiplied by, so that long texts do not score higher for their length."""
    return 1.0 / np.sqrt(max(1.0, float((ratios**2).sum())))


def slot_counts(sample: DataFrame) -> DataFrame:
    """slot, c0, c1: in how many documents of each label the slot occurs; a task adds up its own first."""

    def count(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                seen = list(ngram_slots(text))
                if seen:
                    counts[y, np.unique(np.concatenate(seen))] += 1
        slots = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(slots), 100_000):
            part = slots[at : at + 100_000]
            yield pd.DataFrame({"slot": part.astype(np.int32), "c0": counts[0, part].astype(np.int64), "c1": counts[1, part].astype(np.int64)})

    partial = sample.select("text", "y").mapInPandas(count, "slot int, c0 long, c1 long")
    return partial.groupBy("slot").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def choose_slots(counts: DataFrame, n0: int, n1: int, features: int = FEATURES) -> DataFrame:
    """slot and ratio of the slots with the greatest likelihood ratio statistic of presence against label.

    The ratio is the naive Bayes log-count ratio. Slots in under LEAST_DOCUMENTS documents are left out; of
    equal ones the least slot comes first.
    """

    def part(seen: str, rows: float, share: float) -> str:
        return f"if({seen} > 0, {seen} * ln({seen} / ({rows} * {share!r}D)), 0D)"

    all_rows = n0 + n1
    share0, share1 = n0 / all_rows, n1 / all_rows
    missing = f"({all_rows} - c0 - c1)"
    strength = " + ".join([
        part("c0", "(c0 + c1)", share0), part("c1", "(c0 + c1)", share1),
        part(f"({n0} - c0)", missing, share0), part(f"({n1} - c1)", missing, share1),
    ])
    ratio = f"ln(((c1 + 0.5D) / {n1 + 1}D) / ((c0 + 0.5D) / {n0 + 1}D))"
    kept = counts.filter(F.col("c0") + F.col("c1") >= LEAST_DOCUMENTS)
    scored = kept.select("slot", F.expr(ratio).alias("ratio"), F.round(F.expr(strength), 9).alias("strength"))
    return scored.orderBy(F.desc("strength"), "slot").limit(features).select("slot", "ratio")


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, ridge: float = 1e-4, rounds: int = 300):
    """Weights per feature and a constant: logistic regression on scaled ratios; labels count the same in the loss."""
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    feature = np.concatenate(rows).astype(np.int64)
    values = (ratio[feature] * np.array([length_scale(ratio[row]) for row in rows])[owner]).astype(np.float32)
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    size = len(ratio)
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, values * weights[feature], minlength=len(labels)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance
        gradient = np.append(np.bincount(feature, values * error[owner], minlength=size) + ridge * weights[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        rate = 0.05 * (1 - step / (rounds + 1))
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights[:-1] * ratio, float(weights[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, part: int = 0,
                    most: int = SAMPLE_ROWS, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; with ``keep_row`` also the row as ``row``.

    The fit takes up to ``most`` labelled rows of each label. Slots are counted and chosen on the executors; the
    driver fits on the few features of each sampled row. Null and empty texts have only their frame of
    spaces and get the score of the constant. Repeated rows are scored alike. Without two labels every score
    is 0. Other columns are never read.
    """
    sample = staged(bounded(training_rows(docs, labels, label, parts, part, most), most, "text"), "toxicity-sample")
    sizes = {row["y"]: row["count"] for row in sample.groupBy("y").count().collect()}
    model = None
    if len(sizes) == 2:
        chosen = choose_slots(slot_counts(sample), sizes[0], sizes[1]).collect()
        ratio = np.array([row["ratio"] for row in chosen])
        slots = np.array([row["slot"] for row in chosen], dtype=np.int64)

        @F.pandas_udf("binary")
        def features(texts: pd.Series) -> pd.Series:
            place = places(slots)
            return pd.Series([present(text, place).astype("<i2").tobytes() for text in texts], dtype=object)

        rows = sample.select("doc_id", features(F.col("text")).alias("x"), "y").collect()
        rows.sort(key=lambda row: (row["doc_id"], row["y"], bytes(row["x"])))
        weights, constant = fit([np.frombuffer(row["x"], "<i2") for row in rows], np.array([row["y"] for row in rows]), ratio)
        model = (slots, ratio, weights, constant)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.0] * len(texts))
        slots, ratio, weights, constant = model
        place, z = places(slots), np.full(len(texts), constant)
        for at, text in enumerate(texts):
            found = present(text, place)
            z[at] += weights[found].sum() * length_scale(ratio[found])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    row = [F.struct(*[docs[name] for name in docs.columns]).alias("row")] if keep_row else []
    scored = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), score(F.col("text")).alias("score"), *row)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
