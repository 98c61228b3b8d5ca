"""Pack token streams of several sources into windows that all hold the target proportions."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import bucket_bits, group_key, hash_key, prefix_sums, staged

WINDOW = 2048
END = 1
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Rounds:
    """Deficit round-robin in closed form: what every source has been served after any number of windows.

    In each window the sources take turns. The first may take its share of all slots so far, rounded down,
    less what it has taken; what rounding left over is its deficit and counts in the next window. The next
    source does the same with its share of the slots that then remain, and the last one takes the rest. So
    the total served depends on the number of windows alone: any task can start at any window with the
    right deficits, no source is ever off by more than a few tokens, and each ends when all tokens are placed.
    """

    def __init__(self, totals: list[int], window: int = WINDOW):
        self.totals, self.window, self.all = totals, window, sum(totals)
        self.served = lru_cache(maxsize=4096)(self._served)

    def _served(self, windows: int) -> list[int]:
        slots, tokens, out = min(windows * self.window, self.all), self.all, []
        for total in self.totals:
            taken = slots * total // tokens if tokens else 0
            out.append(taken)
            slots, tokens = slots - taken, tokens - total
        return out

    def window_of(self, source: int, position: int, low: int = 0) -> int:
        """The window that holds this token of the source, at or after window ``low``."""
        step = 1
        while self.served(low + step)[source] <= position:
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            if self.served(middle)[source] <= position:
                low = middle
            else:
                high = middle
        return low

    def pieces(self, source: int, position: int, length: int, low: int = 0):
        """(start, length, window, offset) of each piece of a document that begins at the position."""
        start, window = 0, low
        while start < length:
            window = self.window_of(source, position + start, window)
            before, after = self.served(window), self.served(window + 1)
            size = min(after[source] - position - start, length - start)
            yield start, size, window, sum(after[:source]) - sum(before[:source]) + position + start - before[source]
            start += size


MOST_PARTS = 600_000  # parts of words remembered by a worker: some 100 MB
LONGEST_PART = 64
BYTES_AT_ONCE = 4 << 20  # of text: words are looked up once for so much


class WordTokenizer:
    """Token ids of texts through those of the parts that the tokenizer itself cuts words into.

    The described tokenizer drops white space, cuts the rest into letters, digits and others in lower case, and merges
    within such a part. A word of plain characters, printable ASCII and the letters of Latin-1, is cut here by the same
    pattern; a word with other characters is one part. Arrow cuts many texts into words and numbers the distinct ones;
    of these the parts are looked up, and new ones encoded by the tokenizer. Other tokenizers encode whole texts.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the tokenizer's own pattern
    END_OF_PART = "</w>"  # fixed value: how the tokenizer marks the last token of a part

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        described = json.loads(self.model.to_str())
        steps = [json.dumps(described.get(name)) for name in ("normalizer", "pre_tokenizer")]
        self.by_part = (
            described["post_processor"] is None and described["model"]["type"] == "BPE"
            and described["model"]["end_of_word_suffix"] == self.END_OF_PART
            and all(not each["lstrip"] and not each["rstrip"] and each["content"].startswith("<|") for each in described["added_tokens"])
            and '"type": "Lowercase"' in steps[0] and '"type": "NFC"' in steps[0] and json.dumps(self.SPLIT) in steps[1]
            and '"behavior": "Removed"' in steps[1] and '"add_prefix_space": false' in steps[1]
        )
        # Parts of plain characters are in lower case, composed and cut already: white space alone parts them.
        levels = [step for step in (described["pre_tokenizer"] or {}).get("pretokenizers", []) if step["type"] == "ByteLevel"]
        described |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *levels]}}
        self.of_parts = Tokenizer.from_str(json.dumps(described)) if self.by_part else None
        letters = "a-zß-öø-ÿ"
        self.other = re.compile(r"[^ \t\n\r\x0b\x0c!-~À-ÖØ-öø-ÿ]").search
        self.odd_word = r"<\||[^!-~À-ÖØ-öø-ÿ]"
        self.cut_lines = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|\n|[^{letters}0-9 \t\n\r\x0b\x0c]+").findall
        self.ends = np.zeros(self.model.get_vocab_size(), dtype=bool)
        for token, number in self.model.get_vocab().items():
            self.ends[number] = token.endswith(self.END_OF_PART)
        self.parts: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Plain parts go through the tokenizer's merges as one text, whose tokens say where each part ends; others as texts."""
        plain = [part for part in parts if "<|" not in part and not self.other(part)]
        ids = np.array(self.of_parts.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype=np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(plain):
            raise ValueError("the tokenizer cuts parts further")
        learnt = {part: ids[a:b].tobytes() for part, a, b in zip(plain, [0, *stops.tolist()], stops.tolist())}
        rest = [part for part in parts if part not in learnt]
        learnt |= {part: array("i", each.ids).tobytes() for part, each in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False))}
        self.parts.update((part, ids) for part, ids in learnt.items() if len(part) <= LONGEST_PART)
        return learnt

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of plain words and then of odd ones, each word's followed by -1, and per word where its ids are: starts and sizes."""
        if len(self.parts) > MOST_PARTS:
            self.parts = {}
        odd = pc.match_substring_regex(words, self.odd_word)
        plain = words.filter(pc.invert(odd))
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py() + "\n" if len(plain) else ""
        parts = self.cut_lines(lines.lower())
        parts.extend(chain.from_iterable(zip(words.filter(odd).to_pylist(), repeat("\n"))))
        new = set(parts).difference(self.parts, "\n")
        learnt = self._learn(new) if new else {}
        passing = {part: ids for part, ids in learnt.items() if part not in self.parts} | {"\n": array("i", [-1]).tobytes()}
        self.parts.update(passing)
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), dtype=np.int32)
        for part in passing:
            del self.parts[part]
        ends = np.flatnonzero(ids == -1)
        sizes, odd = np.diff(ends, prepend=-1) - 1, odd.to_numpy(zero_copy_only=False)
        places = np.where(odd, len(plain) + np.cumsum(odd), np.cumsum(~odd)) - 1
        return ids, (ends - sizes)[places], sizes[places]

    def encode_marked(self, texts: pa.Array, mark: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as 32-bit numbers, with the mark after each text, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if self.by_part:
            cut = pc.ascii_split_whitespace(texts)
            counts, coded = pc.list_value_length(cut).to_numpy(), cut.flatten().dictionary_encode()
            numbers = coded.indices.to_numpy()
            ids, starts, sizes = self._ids_of_words(coded.dictionary)
        else:
            counts, numbers = np.ones(len(texts), dtype=np.int32), np.arange(len(texts))
            encoded = [each.ids for each in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids, sizes = np.array([*chain.from_iterable(encoded)], dtype=np.int32), np.array([*map(len, encoded)], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
        numbers = np.insert(numbers, np.cumsum(counts), len(sizes))
        ids, starts, sizes = np.append(ids, np.array(mark, dtype=np.int32)), np.append(starts, len(ids)), np.append(sizes, len(mark))
        lengths = sizes[numbers]
        ends = np.cumsum(lengths)
        places = np.arange(lengths.sum()) + np.repeat(starts[numbers] - ends + lengths, lengths)
        return ids[places], np.diff(ends[np.cumsum(counts + 1) - 1], prepend=0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        ids, lengths = self.encode_marked(pa.array(texts, pa.string()), [])
        ends = np.cumsum(lengths)
        return [ids[end - length : end].tobytes() for end, length in zip(ends, lengths)]


def slices(sizes: np.ndarray, most: int):
    """(first, number) of runs of items, each with the given size at most in all, or of one item."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        following = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, following - at
        at = following


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def id_type_of(tokenizer: str) -> str:
    """How ids are stored: two bytes each where the whole vocabulary fits, else four."""
    return "<u2" if _tokenizer(tokenizer).model.get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, source_key, key, ids (with the end mark, bytes as ``id_type_of`` says) and n_tokens per document."""

    def encode(batches):
        model, stored = _tokenizer(tokenizer), id_type_of(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            for at, number in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), BYTES_AT_ONCE):
                ids, lengths = model.encode_marked(texts.slice(at, number), [END])
                offsets = (np.concatenate([[0], np.cumsum(lengths)]) * np.dtype(stored).itemsize).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), number, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(stored))])
                rest = [batch.column(name).slice(at, number) for name in ("doc_id", "source", "source_key", "key")]
                yield pa.RecordBatch.from_arrays(
                    [*rest, packed, pa.array(lengths)], names=["doc_id", "source", "source_key", "key", "ids", "n_tokens"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select(
        "doc_id", "source", group_key("source").alias("source_key"), hash_key("doc_id").alias("key"), "text"
    )
    return narrow.mapInArrow(encode, f"doc_id {id_type}, source string, source_key string, key long, ids binary, n_tokens long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most ``window`` tokens.

    Target proportions are the sources' shares of all tokens, so every sequence holds the whole mixture and
    the sources end together; only the last sequence can be short. A null or empty text is its end mark alone.
    A null source is a source of its own; rows with the same id are separate documents; other columns are not
    looked at; no documents give no pieces. The driver holds one number per source.
    """
    tokens = staged(tokenised(docs, tokenizer), "tokens")
    totals = tokens.groupBy("source_key").agg(F.sum("n_tokens").alias("total")).orderBy("source_key").collect()
    numbers = {row["source_key"]: at for at, row in enumerate(totals)}
    amounts = [row["total"] for row in totals]
    placed = prefix_sums(tokens, "source_key", "key", "n_tokens", ["doc_id", "n_tokens"], bucket_bits(tokens.count(), 1024))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names, stored = [part.split()[0] for part in PIECES.split(", ")], id_type_of(tokenizer)

    def cut(batches):
        rounds, last, crc32 = Rounds(amounts, window), {}, zlib.crc32
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "source", "source_key", "before")]
            packed, out = batch.column("ids"), []
            offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
            data = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(stored).astype("<u4")
            ends = ((offsets - offsets[0]) // np.dtype(stored).itemsize).tolist()
            for at, (doc_id, source, source_key, before) in enumerate(zip(*columns)):
                ids = data[ends[at] : ends[at + 1]]
                number = numbers[source_key]
                seen, low = last.get(number, (0, 0))
                first = rounds.window_of(number, before, low if before >= seen else 0)
                last[number] = (before, first)
                size = len(ids)
                for start, length, sequence, offset in rounds.pieces(number, before, size, first):
                    out.append((doc_id, start, length, crc32(ids[start : start + length]), size, sequence, offset, source))
            if out:
                yield pa.RecordBatch.from_pydict(
                    {name: list(values) for name, values in zip(names, zip(*out))}, schema=schema
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    result = placed.select("doc_id", "source", "source_key", "before", "ids")
    ddl = PIECES.format(id=id_type)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    return result.mapInArrow(cut, ddl)
