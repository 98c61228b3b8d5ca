"""Encoding and decoding against the library, over whole texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from rosterline.llm import queries, sentence_pieces
from tests.llm.test_operators import SCHEMA, rows_of

ODD = [
    "a", "b", " ", "  ", "▁", "é", "ｆ", "\U0001f600", "\x00", "\n", "\t", "<s>", "</s>", "<unk>", "<0x41>", "the ", "ing", "1", "23",
    " ▁", "ﬁ", "​", "́", "한", "字", "'s", "�",
]


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(queries.piece_bpe())


def test_odd_texts_and_ids(pieces):
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randrange(25)))
        assert pieces.encode([text]) == [pieces.library.encode(text)]
        ids = [draw.choice([draw.randrange(32_000), draw.randrange(259), 29_871, 259]) for _ in range(draw.randrange(12))]
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_chunks():
    pattern = sentence_pieces._chunk_pattern(["▁a", "ab", "a", "(a", "((", "▁▁"])
    cut = re.compile(pattern).findall("▁▁ab(ab((a)x▁(▁")
    assert cut == ["▁▁ab", "(ab", "((a", ")", "x", "▁(", "▁"]
    assert re.compile(sentence_pieces._chunk_pattern(["a▁"])).findall("x a\ny") == ["x a\ny"]
    assert re.compile(sentence_pieces._chunk_pattern(["a(", "ba"])).findall("ba(▁a") == ["ba(", "▁a"]


def test_long_chunks(pieces):
    for text in ("aaaab" * 8000, " " * 5000, "\U0001f600" * 3000, "▁" * 3000 + "x", "the" * 6000):
        assert pieces.encode([text]) == [pieces.library.encode(text)]
        assert pieces.decode(pieces.encode([text])[0]) == pieces.library.decode(pieces.library.encode(text))


def test_cache_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MOST_CACHED", 5)
    pieces.recent, pieces.older = {}, {}
    text = " ".join(f"w{i % 13}x" for i in range(100)) + " " + "y" * 100
    assert pieces.encode([text]) == [pieces.library.encode(text)]
    assert len(pieces.recent) <= 2 and len(pieces.older) <= 2


def test_a_difference_fails(pieces, monkeypatch):
    monkeypatch.setattr(type(pieces), "encode_chunk", lambda self, chunk: [5])
    pieces.recent, pieces.older = {}, {}
    with pytest.raises(sentence_pieces.MismatchError):
        pieces.both_ways(["some text"])
    pieces.recent, pieces.older = {}, {}


def test_whole_texts_of_the_table(pieces):
    import pyarrow.parquet as pq

    texts = [text or "" for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    ids, decoded = pieces.both_ways(texts)
    assert ids == pieces.library.encode(texts) and decoded == pieces.library.decode(ids)


def test_query(spark, tmp_path, pieces):
    rows = rows_of() + [(2000 + i, text, "en", "s", 0, "r", 0, "k", 0) for i, text in enumerate(["", " ", "x" * 5000, "".join(ODD) * 20])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_sentence_pieces(spark, str(tmp_path))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = Counter()
    for row in rows:
        ids = pieces.library.encode(row[1] or "")
        want[(row[0], len(ids), digest(",".join(map(str, ids))), digest(pieces.library.decode(ids))),] += 1
    assert Counter((tuple(row),) for row in out.collect()) == want
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sentence_pieces.encoded(docs.limit(0), queries.piece_bpe()).count() == 0
    unchecked = sentence_pieces.encoded(docs, queries.piece_bpe(), check=False)
    assert Counter(len(row["ids"]) for row in unchecked.collect()) == Counter(len(pieces.library.encode(r[1] or "")) for r in rows)
