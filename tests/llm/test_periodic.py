"""Runs against a scan of every lag, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rosterline.llm import periodic, queries
from tests.llm.test_operators import SCHEMA, rows_of

WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def plain_row(doc_id, text):
    words = re.findall(WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    kept = " ".join(word for i, word in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def nested(draw, depth):
    if not depth:
        return [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(1, 12))]
    part = nested(draw, depth - 1)
    return part * draw.randrange(1, 6) if draw.random() < 0.5 else part + nested(draw, depth - 1)


def test_runs_of_repetitive_sequences():
    draw, found = random.Random(5), 0
    fibonacci = [0], [0, 1]
    for _ in range(10):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    cases = [[], [1], [1] * 11, [1] * 12, [1] * 400, fibonacci[1], [1, 2] * 150 + [3] + [1, 2] * 150]
    cases += [nested(draw, draw.randrange(1, 6))[:500] for _ in range(150)]
    for _ in range(150):  # copies of a stretch that itself repeats a shorter one, which goes on outside
        u = [draw.randrange(2) for _ in range(draw.randrange(1, 9))]
        x = (u * 60)[: draw.randrange(16, 120)] + [draw.randrange(3) for _ in range(draw.randrange(3))]
        cases.append((u * 20)[-draw.randrange(1, 40):] + x * draw.randrange(2, 4) + (x * 2)[: draw.randrange(150)])
    for words in cases:
        want = plain_runs(words)
        assert [tuple(run) for run in periodic.runs_of(np.array(words, dtype=np.int32)).tolist()] == want
        found += sum(q >= periodic.DIRECT for _, _, q in want)
    assert found > 1000


def test_wrong_hashes_do_not_matter(monkeypatch):
    # With the base 1 and equal values all stretches of a length hash alike; what is found is then compared.
    monkeypatch.setattr(periodic, "_mixed", lambda values: values * np.uint64(0) + np.uint64(1))
    words = np.array([1, 2, 3] * 30 + list(range(100, 140)) + list(range(200, 220)) * 3, dtype=np.int32)
    got = {tuple(run) for run in periodic.runs_of(words).tolist()}
    assert got <= set(plain_runs(words.tolist())) and (0, 90, 3) in got


def test_few_seeds_for_one_word():
    pairs = []
    original = periodic._pairs
    periodic._pairs = lambda *a: pairs.append(original(*a)) or pairs[-1]
    try:
        words = np.array(([7] * 500 + [8]) * 40, dtype=np.int32)
        assert [tuple(r) for r in periodic.runs_of(words).tolist() if r[2] > 1] == [(0, len(words), 501)]
    finally:
        periodic._pairs = original
    assert sum(len(x) for x, _ in pairs) < 10 * len(words)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    more = [" ".join(draw.choice("abcd") * draw.randrange(1, 3) for _ in range(n)) for n in (30, 900, 4000, 12, 200)]
    more += [" ".join(["x"] * 3000), " ".join(["un", "deux", "trois,"] * 40) + "\n" + "fin " * 13, "    été " * 20]
    made = rows_of()
    return made + [(1000 + i, more[i % len(more)], "en", "s", 0, "r", 0, "k", 0) for i in range(80)]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns[:8] == names and dict(out.dtypes)["n_runs"] == "bigint" and dict(out.dtypes)["exponent_milli"] == "bigint"
    got = Counter(tuple(row[name] for name in names) for row in out.collect())
    assert got == Counter(plain_row(r[0], r[1]) for r in rows)
    assert sum(row[1] > 0 for row in got) > 30


def test_blocks_and_empty_tables(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = periodic.periodic_runs(docs).toPandas()
    monkeypatch.setattr(periodic, "BLOCK", 50)
    assert len(whole) == len(rows)
    texts = [(r[1] or "").encode().split() for r in rows]
    runs, collapsed = periodic._block(texts)
    alone = [periodic._block([words]) for words in texts if words]
    assert [r for r, words in zip(runs, texts) if words] == [r[0] for r, _ in alone]
    assert [c for c, words in zip(collapsed, texts) if words] == [c[0] for _, c in alone]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
