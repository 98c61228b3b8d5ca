"""Document quality learnt from preference pairs by the Bradley-Terry model."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import column_function, staged

FEATURES = 24
GRAIN = 1 << 12  # parts of a spread that features are rounded to in the fit
STEP, REACH = 0.125, 16.0  # scores are rounded to, and bounded by, in the fit
CUT = 0.7


def features(text: str | None) -> list[float]:
    """What the form of a whole text says of its quality; its words themselves do not matter."""
    text = text or ""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, w, lc = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    lower = [word.lower() for word in words]
    three = list(zip(lower, lower[1:], lower[2:]))
    symbol = sum(text.count(each) for each in "#*$%&")
    ends = sum(text.count(each) for each in ".!?")
    letters = sum(map(str.isalpha, text))
    upper_words = sum(1 for word in words if len(word) > 1 and word.upper() == word and word.lower() != word)
    digits = sum(text.count(each) for each in "0123456789")
    return [
        min(np.log1p(len(words)), 12.0), float(len(words) < 20), float(len(words) < 50),
        min(symbol / w, 3.0), np.sqrt(symbol / n), min(text.count("|") / w, 1.0), min(text.count("!") / w, 2.0),
        upper_words / w, np.sqrt(upper_words / w), min(letters / n, 1.0), digits / n, np.sqrt(digits / n),
        len(set(lower)) / w, len(set(three)) / max(len(three), 1), len(set(lines)) / lc,
        sum(map(len, words)) / w / 10, ends / w, w / lc / 100 if w / lc < 500 else 5.0,
        sum(1 for line in lines if line.rstrip()[-1] in ".!?\"'") / lc, float(not words),
        min(text.count("http") / w * 10, 2.0), min((text.count("{") + text.count("}") + text.count("<") + text.count(">")) / w, 2.0),
        max(0.0, 1 - len(set(three)) / max(len(three), 1) - 0.3), sum(1 for line in lines if len(line) < 30) / lc,
    ]


def exact_sums(rows: DataFrame, sums) -> list:
    """(slot, total) over all rows: ``sums`` of some rows' ``x`` and ``y`` gives slots, each with whole numbers to add up.

    Whole numbers add up to the same sum in any order, so reruns agree. The driver gets one row per slot.
    """

    def partial(batches):
        found = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                for slot, values in sums(np.array(part["x"].tolist()).reshape(-1, FEATURES), part["y"].to_numpy()):
                    values = np.rint(values).astype(np.int64)
                    found[slot] = found[slot] + values if slot in found else values
        if found:
            yield pd.DataFrame({"slot": list(found), "sums": [values.tolist() for values in found.values()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": group["slot"].iloc[:1], "sums": [np.sum([*group["sums"]], axis=0).tolist()]})

    kind = "slot long, sums array<long>"
    total = rows.mapInPandas(partial, kind).groupBy("slot").applyInPandas(added, kind).collect()
    return sorted((row["slot"], np.array(row["sums"], dtype=float)) for row in total)


def spread_of(rows: DataFrame):
    """Mean and spread of each feature over all rows; features that do not vary have the spread 1."""
    fine = 1 << 24

    def sums(x, y):
        yield 0, np.concatenate([[len(x)], np.rint(x * fine).sum(axis=0), np.rint(x * x * fine).sum(axis=0)])

    found = exact_sums(rows, sums)
    if not found:
        return np.zeros(FEATURES), np.ones(FEATURES)
    n, values, squares = found[0][1][0], found[0][1][1 : 1 + FEATURES] / fine, found[0][1][1 + FEATURES :] / fine
    spread = np.sqrt(np.maximum(squares / n - (values / n) ** 2, 0))
    spread[spread < 1e-3] = 1.0
    return values / n, spread


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features by their spread, as whole multiples of 1 / GRAIN."""
    return np.rint(np.clip((x - mean) / spread, -64, 64) * GRAIN)


def fit_pairs(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of the Bradley-Terry model: the chance that a beats b is the logistic of weights · (a - b).

    All pairs of one row of each label count, but none is formed: what a pair adds depends on the two scores, so rows
    are summed by label and score, rounded to STEP, and the sums are paired at the mean scores of their rows. The
    logistic loss with a small ridge has one minimum, which Newton's method finds, in one job per round.
    """
    weights = np.zeros(FEATURES)
    for _ in range(rounds):

        def sums(x, y, weights=weights):
            z = scaled(x, mean, spread)
            slots = 2 * np.rint(np.clip(z @ weights / GRAIN, -REACH, REACH) / STEP).astype(np.int64) + y
            for slot in np.unique(slots).tolist():
                some = z[slots == slot]
                yield slot, np.concatenate([[len(some)], some.sum(axis=0), (some.T @ some).ravel()])

        found = exact_sums(rows, sums)
        sides = []
        for y in (1, 0):
            side = np.array([values for slot, values in found if slot % 2 == y])
            n = side[:, 0]
            means = side[:, 1 : 1 + FEATURES] / n[:, None] / GRAIN
            sides.append((n / n.sum(), means, side[:, 1 + FEATURES :].reshape(-1, FEATURES, FEATURES) / n[:, None, None] / GRAIN**2))
        (share1, good, square1), (share0, bad, square0) = sides
        wins = 1 / (1 + np.exp(-np.clip((good @ weights)[:, None] - (bad @ weights)[None, :], -30, 30)))
        pairs = share1[:, None] * share0[None, :]
        lost, curved = pairs * (wins - 1), pairs * wins * (1 - wins)
        gradient = lost.sum(axis=1) @ good - lost.sum(axis=0) @ bad + ridge * weights
        cross = good.T @ curved @ bad
        curve = np.tensordot(curved.sum(axis=1), square1, 1) + np.tensordot(curved.sum(axis=0), square0, 1) - cross - cross.T
        step = np.linalg.solve(curve + ridge * np.eye(FEATURES), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def threshold_of(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> tuple[float, float]:
    """The score that parts the labels best, each label counting the same, and a quarter of the median distance to it.

    All rows are counted by label and score, rounded to 1 / 512; the threshold is the middle of the best places.
    """

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        z = scaled(np.array(x.tolist()).reshape(-1, FEATURES), mean, spread) / GRAIN
        return pd.Series(np.rint(np.clip((z * weights).sum(axis=1), -64, 64) * 512).astype(np.int64))

    counts = sorted(rows.groupBy(place("x").alias("place")).agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect())
    values = np.array([row["place"] for row in counts]) / 512
    ones, n = np.array([row["ones"] for row in counts]), np.array([row["n"] for row in counts])
    missed = np.concatenate([[0], np.cumsum(ones)]) / ones.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(n - ones)]) / (n - ones).sum()
    best = np.flatnonzero(missed + passed <= (missed + passed).min() + 1e-12)
    at = best[len(best) // 2]
    threshold = float(values[max(at - 1, 0)] + values[min(at, len(values) - 1)]) / 2
    distance = np.abs(values - threshold)
    order = np.argsort(distance, kind="stable")
    median = distance[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
    return threshold, max(float(median) / 4, 1e-3)


def held_out(doc_id, parts: int, part: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int) -> list:
    """(text, label) of labelled rows that are not held out, of up to ``most`` ids of each label, the least by a hash.

    Only rows whose label is 0 or 1 count; a document labelled twice counts for each. As ids can repeat, ``bounded``
    must follow, once the rows are as narrow as they get.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), parts, part))
    chosen = [
        known.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most) for y in (0, 1)
    ]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # ids and labels of 2 * most rows at the most
    return docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "y")


def bounded(rows: DataFrame, most: int, tie: str) -> DataFrame:
    """Up to ``most`` rows of each label ``y``, the least by hashes of the id and a column; each task sends no more."""
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", F.xxhash64(tie))
    return rows.withColumn("_number", F.row_number().over(order)).filter(F.col("_number") <= most).drop("_number")


@column_function("array<double>")
def feature_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([[float(x) for x in features(text)] for text in texts], dtype=object)


def preference_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The fit takes every labelled row that is not held out; a document labelled twice counts for each. Features are
    staged once, and the rounds of the fit read those of the labelled rows. Scores are the logistic of the distance to
    the threshold, moved so that it lies at 0.7. Null and empty texts have the features of no words and get the score
    those give. Without two labels every score is 0.5. Other columns are never read.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("long").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), parts, part))
    every = staged(docs.select("doc_id", feature_rows(F.col("text")).alias("x")), "features")
    rows = staged(every.join(known, "doc_id").select("y", "x"), "training")
    mean, spread = spread_of(rows)
    two = rows.select("y").distinct().count() == 2
    weights = fit_pairs(rows, mean, spread) if two else np.zeros(FEATURES)
    threshold, width = threshold_of(rows, weights, mean, spread) if two else (None, 1.0)
    shift = float(np.log(CUT / (1 - CUT)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if threshold is None:
            return pd.Series([0.5] * len(x))
        z = np.clip((np.array(x.tolist()).reshape(-1, FEATURES) - mean) / spread, -64, 64)
        return pd.Series(1 / (1 + np.exp(-np.clip(((z * weights).sum(axis=1) - threshold) / width + shift, -30, 30))))

    scored = every.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
