"""Stretches of words that repeat with a period, found from minimizers at several scales."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

LEAST_LENGTH = 12
DIRECT = 16  # shorter periods are scanned for lag by lag
KMER = 4
BLOCK = 1 << 16  # words looked at together
MOST_CANDIDATES = 1 << 18  # seeds extended at a time
BASE = 0x9E3779B97F4A7C15  # any odd number
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Hashes:
    """Hashes of all stretches of a sequence of words, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.full(n + 1, BASE, dtype=np.uint64)
        inverses = np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverses[0] = 1
        self.powers, self.inverses = np.cumprod(powers), np.cumprod(inverses)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverses[at]

    def same(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        left = (self.sums[x + length] - self.sums[x]) * self.powers[y - x]
        return left == self.sums[y + length] - self.sums[y]


def _position_bits(n: int) -> int:
    return max(24, n.bit_length() + 1)


def _selected(order: np.ndarray, window: int, narrower: tuple[int, np.ndarray], bits: int) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
    """Positions that are the leftmost minimum of some window, and minima over the widest power of two in it.

    ``order`` has a position in its lowest bits, which decides between equal hashes.
    """
    width, least = narrower
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    minima = np.minimum(least[: len(order) - window + 1], least[window - width :])
    positions = (minima & np.uint64((1 << bits) - 1)).astype(np.int64)
    return positions[np.flatnonzero(np.diff(positions, prepend=-1))], (width, least)


def _pairs(positions: np.ndarray, keys: np.ndarray, scale: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of minimizers with equal keys from 2 to under 4 scales apart, as (position, distance).

    Equal minimizers at most half a scale apart overlap in text of a short period and form a chain, of which a
    stretch of few words has very many. A pair is taken only if one of the two ends its chain, and never within a
    chain: a run whose copies pair up chain by chain has such a pair, since its chains cannot go on for a
    whole period without the run having their period. So there are a few pairs per minimizer, however often one repeats.
    """
    by_key = np.argsort(keys, kind="stable")
    positions, keys = positions[by_key], keys[by_key]
    equal = keys[1:] == keys[:-1]
    repeated = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    positions, keys = positions[repeated], keys[repeated]
    if not len(positions):
        return positions, positions
    starts = np.ones(len(positions), dtype=bool)
    starts[1:] = (keys[1:] != keys[:-1]) | (np.diff(positions) > scale // 2)
    chain = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(positions)) - 1
    placed = (chain << bits) | positions
    ends = positions[first], positions[last]
    froms, distances = [], []

    def take(fixed: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, fixed_is_left: bool) -> None:
        """Pair each fixed position with those of the other chain from ``low`` to under ``high``."""
        begin = np.searchsorted(placed, (other << bits) | np.maximum(low, 0))
        count = np.searchsorted(placed, (other << bits) | np.clip(high, 0, (1 << bits) - 1)) - begin
        count = np.maximum(count, 0)
        mine = np.repeat(fixed, count)
        at = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        theirs = positions[at]
        froms.append(mine if fixed_is_left else theirs)
        distances.append(theirs - mine if fixed_is_left else mine - theirs)

    step = 1
    while step < len(first):
        a = np.arange(len(first) - step)
        b = a + step
        near = (keys[first[a]] == keys[first[b]]) & (ends[0][b] - ends[1][a] < 4 * scale)
        if not near.any():
            break
        a, b = a[near], b[near]
        for end in ends:
            take(end[a], b, end[a] + 2 * scale, end[a] + 4 * scale, True)
            take(end[b], a, end[b] - 4 * scale + 1, end[b] - 2 * scale + 1, False)
        step += 1
    if not froms:
        return positions[:0], positions[:0]
    seeds = np.unique((np.concatenate(distances) << bits) | np.concatenate(froms))
    return seeds & ((1 << bits) - 1), seeds >> bits


def _extended(hashes: _Hashes, x: np.ndarray, y: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and from x on equal those before and from y on."""
    n = len(hashes.sums) - 1
    before, after = np.zeros_like(x), np.zeros_like(x)
    step = 1 << longest.bit_length()
    while step:
        more = after + step
        fits = y + more <= n
        more = np.where(fits, more, 0)
        after = np.where(fits & hashes.same(x, y, more), more, after)
        more = before + step
        fits = x >= more
        more = np.where(fits, more, 0)
        before = np.where(fits & hashes.same(x - more, y - more, more), more, before)
        step >>= 1
    return before, after


def _lag_stretches(words: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal stretches of at least so many words that equal the word ``lag`` later."""
    hits = np.flatnonzero(words[:-lag] == words[lag:])
    if not len(hits):
        return hits, hits
    breaks = np.flatnonzero(np.diff(hits) > 1)
    start = hits[np.concatenate([[0], breaks + 1])]
    end = hits[np.concatenate([breaks, [len(hits) - 1]])] + 1
    long = end - start >= least
    return start[long], end[long]


def runs_of(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, end, period) of every run, by start.

    A run is a stretch with smallest period q, of at least ``max(LEAST_LENGTH, 2 * q)`` words, that no
    neighbouring word extends. ``longest`` bounds the length of a run, where that is known to be less than all words.

    Periods under DIRECT are scanned for lag by lag. Beyond, each scale c = 8, 16, 32 ... finds the periods from 2c
    to under 4c: a run of two such periods holds a window of c words and its copy one period on, whose minimizers
    lie one period apart, with equal c words from there on within the run. Such pairs are extended to both sides by
    hashes of stretches; every run is then compared word by word, and scanned for by its lag if hashes erred.
    """
    n = len(words)
    longest = n if longest is None else min(longest, n)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for lag in range(1, min(DIRECT - 1, longest // 2) + 1):
        start, end = _lag_stretches(words, lag, max(LEAST_LENGTH, 2 * lag) - lag)
        found.append(np.column_stack([start, end + lag, np.full(len(start), lag)]))
    scale = DIRECT // 2
    if longest >= 4 * scale:
        hashes = _Hashes(words)
        kmers = _mixed(hashes.of(np.arange(n - KMER + 1), KMER))
        bits = _position_bits(n)
        order = (kmers & ~np.uint64((1 << bits) - 1)) | np.arange(len(kmers), dtype=np.uint64)
        narrower = (1, order)
        while 4 * scale <= longest:
            positions, narrower = _selected(order, scale - KMER + 1, narrower, bits)
            positions = positions[positions + scale <= n]
            x, period = _pairs(positions, hashes.of(positions, scale), scale, bits)
            for at in range(0, len(x), MOST_CANDIDATES):
                left, q = x[at : at + MOST_CANDIDATES], period[at : at + MOST_CANDIDATES]
                before, after = _extended(hashes, left, left + q, longest)
                enough = before + after >= q
                runs = np.column_stack([left - before, left + q + after, q])[enough]
                found.append(_compared(words, np.unique(runs, axis=0)))
            scale *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch has one smallest period: any other lag it was found with is a multiple of it.
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def _compared(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    wrong = [not np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in runs.tolist()]
    if not any(wrong):
        return runs
    again = [runs[~np.array(wrong)]]
    for q in np.unique(runs[wrong][:, 2]).tolist():
        start, end = _lag_stretches(words, q, q)
        again.append(np.column_stack([start, end + q, np.full(len(start), q)]))
    return np.concatenate(again)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _block(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each document; between documents stands a word that occurs nowhere else."""
    numbers, lengths = _Numbers(), np.array([len(words) for words in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    sequence = np.empty(int(starts[-1]), dtype=np.int32)
    for start, words in zip(starts.tolist(), texts):
        sequence[start : start + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    sequence[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    runs = runs_of(sequence, int(lengths.max()))
    change = np.zeros(len(sequence) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    mine = [[] for _ in texts]
    for number, (start, end, period) in zip(owner.tolist(), runs.tolist()):
        mine[number].append({"start": start - int(starts[number]), "length": end - start, "period": period})
    collapsed = [
        b" ".join(compress(words, kept[start : start + len(words)].tolist()) if found else words)
        for start, words, found in zip(starts.tolist(), texts, mine)
    ]
    return mine, collapsed


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start) and ``collapsed`` for every document.

    Words are what white space of ASCII parts. ``collapsed`` has the words, joined by one space, that lie in no run
    after its first period. A null or empty text has no words and no runs, and collapses to an empty text. Rows that
    repeat an id or a text are documents of their own; an empty table gives no rows; other columns are not looked at.
    A text is held by one task, whatever its length, with some tens of bytes a word beside it; its work grows
    with its words and the logarithm of their number, also where one word fills all of it.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    ddl = f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def find(batches):
        for batch in batches:
            ids, column = batch.column("doc_id").cast(schema.field("doc_id").type), batch.column("text")
            first, texts, size = 0, [], 0
            for at in range(batch.num_rows):
                texts.append((column[at].as_py() or b"").split())
                size += len(texts[-1])
                if size >= BLOCK or at == batch.num_rows - 1:
                    runs, collapsed = _block(texts)
                    counts = [len(words) for words in texts]
                    values = [counts, runs, [text.decode("utf-8", "replace") for text in collapsed]]
                    arrays = [pa.array(value, field.type) for value, field in zip(values, list(schema)[1:])]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), *arrays], schema=schema)
                    first, texts, size = at + 1, [], 0

    return narrow.mapInArrow(find, ddl)
