"""Ids by word against the tokenizer's own, over whole texts."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rosterline.llm import packing, queries

ODD = [
    "a", "B", "é", "É", "ß", "İ", "ﬁ", "ǅ", "́", "​", " ", " ", "\x1c", "\x85", "\t", "\n", " ", "  ", "'", "'s", "'S", "'ll", "’s",
    "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "1", "23", "²", "½", "٣", "_", "$$", "—", "…", "字", "한", "\U0001f600", "×", "÷", "\x00", "x1y", "�",
]


@pytest.fixture
def both():
    path = queries.word_bpe()
    return packing.WordTokenizer(path), Tokenizer.from_file(path)


def same(words, whole, texts):
    got = [array("i", ids).tolist() for ids in words.encode(texts)]
    want = [each.ids for each in whole.encode_batch([text or "" for text in texts], add_special_tokens=False)]
    for text, a, b in zip(texts, got, want):
        assert a == b, repr(text)


def test_odd_texts(both):
    draw = random.Random(4)
    assert both[0].by_part
    same(*both, ["".join(draw.choice(ODD) for _ in range(draw.randrange(14))) for _ in range(6000)])


def test_given_texts(both):
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()[:4000]
    for at in range(0, len(texts), 500):
        same(*both, [None, "", *texts[at : at + 500]])


def test_memory_is_bounded_and_long_words_are_not_kept(both, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PARTS", 20)
    for _ in range(3):
        same(*both, [" ".join(f"w{i}x" for i in range(40)), "y" * 5000 + " " + "é" * 3000])
    assert "y" * 5000 not in both[0].parts and len(both[0].parts) <= 53


def test_a_word_of_many_texts_is_cut_once(both):
    cut, seen = both[0].cut_lines, []
    both[0].cut_lines = lambda text: seen.append(len(text)) or cut(text)
    same(*both, ["It's " + "some words, " * 2000] * 50)
    assert sum(seen) < 100


def test_slices_hold_so_many_bytes_or_one_text():
    sizes = np.array([3, 0, 4, 9, 1, 1, 0], dtype=np.int32)
    assert list(packing.slices(sizes, 7)) == [(0, 3), (3, 1), (4, 3)]
    assert list(packing.slices(sizes[:0], 7)) == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    path = str(tmp_path / "other.json")
    model = Tokenizer.from_file(queries.word_bpe())
    model.normalizer = None
    model.save(path)
    words = packing.WordTokenizer(path)
    assert not words.by_part
    same(words, Tokenizer.from_file(path), ["A b", "c  D"])
