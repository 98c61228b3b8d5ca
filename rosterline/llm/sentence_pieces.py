"""Encoding and decoding with a SentencePiece vocabulary whose pieces were made by merging."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SPACE = "▁"  # stands for a space in pieces
SLICE = 256  # documents encoded and checked together
MOST_CACHED = 500_000  # chunks of at most LONGEST_CACHED symbols remembered by a worker: some 150 MB
LONGEST_CACHED = 64
WHOLE = "(?s:.+)"  # the chunk pattern where texts cannot be cut
MARK = "\x00"  # put before a chunk, so that the library puts no space there
NOT_UTF8 = "�"


class MismatchError(RuntimeError):
    """The library gives other ids, or another text, than this module."""


def _chunk_pattern(pieces: Iterable[str]) -> str:
    """A pattern for the chunks of a text: stretches that no piece reaches beyond, so that no merge does either.

    A text is cut between two symbols that stand beside each other in no piece: around symbols that no piece joins
    with another; before a space, if no piece has one behind another symbol; and behind a letter before what is
    none, if no piece holds the two.
    """
    pairs = {piece[at : at + 2] for piece in pieces for at in range(len(piece) - 1)}
    joined = {symbol for pair in pairs for symbol in pair} - {SPACE}
    if any(second == SPACE != first for first, second in pairs):
        return WHOLE
    letters = sorted(symbol for symbol in joined if symbol.isalpha())
    others = sorted(joined.difference(letters))
    inner = "".join(map(re.escape, [*others, *letters]))
    if not letters or not others or any(first in letters and second in others for first, second in pairs):
        return f"{SPACE}*[{inner}]+|{SPACE}+|(?s:.)" if inner else f"{SPACE}+|(?s:.)"
    letters, others = ("".join(map(re.escape, each)) for each in (letters, others))
    return f"{SPACE}*[{others}]*[{letters}]+|{SPACE}*[{others}]+|{SPACE}+|(?s:.)"


class Pieces:
    """A merge-type vocabulary with byte fallback, spaces kept, and one space put before the text.

    Other kinds are refused: normalised, unigram, with user-defined or unused pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.piece_size()
        texts = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) for i in range(size)]
        byte = [library.is_byte(i) for i in range(size)]
        self.unknown = library.unk_id()
        self.ids = {text: i for i, text in enumerate(texts) if not special[i] and not byte[i]}
        self.scores = [library.get_score(i) for i in range(size)]
        self.bytes = {int(text[3:-1], 16): i for i, text in enumerate(texts) if byte[i]}
        if len(self.bytes) != 256 or any(library.is_unused(i) for i in range(size)):
            raise ValueError(f"{path!r} has no byte pieces, or unused ones")
        probe = "  ａ ﬁ b  \n"
        if library.decode(library.encode(probe)) != probe or not library.id_to_piece(library.encode("a")[0]).startswith(SPACE):
            raise ValueError(f"{path!r} changes texts before it encodes them")
        pattern = WHOLE if any(MARK in text for text in self.ids) else _chunk_pattern(self.ids)
        self.chunk, self.lead = re.compile(pattern), [] if pattern == WHOLE else library.encode(MARK)
        self.ranks = {text: -self.scores[i] for text, i in self.ids.items()}
        self.plain = [b"" if library.is_control(i) else texts[i].replace(SPACE, " ").encode() for i in range(size)]
        self.plain[self.unknown] = " ⁇ ".encode()  # fixed value: what the library prints for an unknown piece
        self.raw = {i: value for value, i in self.bytes.items()}
        for i, value in self.raw.items():
            self.plain[i] = bytes([value])
        self.shown = [not library.is_control(i) for i in range(size)]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without a cut.

        Starts from single characters. The agenda holds each two neighbours whose joined text is a piece, by
        score, the leftmost of equals first. The best is merged and its new neighbours join the agenda; an entry is
        stale when one of its two symbols has changed since. What is no piece in the end goes out as bytes.
        """
        end, ranks = len(chunk), self.ranks
        symbols, before, after = list(chunk), list(range(-1, end - 1)), list(range(1, end + 1))
        agenda = [(ranks[pair], at, pair) for at in range(end - 1) if (pair := chunk[at : at + 2]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            right = after[left]
            if right >= end or not symbols[left] or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            following, preceding = after[right], before[left]
            after[left] = following
            if following < end:
                before[following] = left
                longer = joined + symbols[following]
                if longer in ranks:
                    heapq.heappush(agenda, (ranks[longer], left, longer))
            if preceding >= 0:
                longer = symbols[preceding] + joined
                if longer in ranks:
                    heapq.heappush(agenda, (ranks[longer], preceding, longer))
        out: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif symbol:
                out.extend(self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass"))
        return out

    def encode(self, texts: list[str], check: bool = True) -> list[list[int]]:
        """Ids of whole texts, without begin or end.

        Chunks that are not remembered are encoded, and with ``check`` compared with what the library gives for
        them, all in one call: so every id that goes out is the library's as well.
        """
        new: dict[str, bytes] = {}
        out = []
        for text in texts:
            chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []
            found = list(map(self.recent.get, chunks))
            if None in found:
                found = [ids if ids is not None else self._looked_up(chunk, new) for chunk, ids in zip(chunks, found)]
            out.append(array("i", b"".join(found)).tolist())
        if check and new and [array("i", ids).tolist() for ids in new.values()] != self._library_ids(list(new)):
            raise MismatchError("the library encodes a text of this batch otherwise")
        return out

    def _looked_up(self, chunk: str, new: dict[str, bytes]) -> bytes:
        """Ids of a chunk, remembered. Half of the memory is given up at a time: what was not met since the last time."""
        ids = self.recent.get(chunk) or new.get(chunk) or self.older.get(chunk)
        if ids is None:
            ids = new[chunk] = array("i", self.encode_chunk(chunk)).tobytes()
        if len(chunk) <= LONGEST_CACHED:
            if len(self.recent) >= MOST_CACHED // 2:
                self.recent, self.older = {}, self.recent
            self.recent[chunk] = ids
        return ids

    def _library_ids(self, chunks: list[str]) -> list[list[int]]:
        if not self.lead:  # texts are not cut: a chunk is a text with the space put before it
            return self.library.encode([chunk[1:] for chunk in chunks], num_threads=1)
        return [ids[len(self.lead):] for ids in self.library.encode([MARK + chunk for chunk in chunks], num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: without the space put before it, and a mark for each byte that is not UTF-8."""
        plain = self.plain
        joined = b"".join([plain[i] for i in ids])
        first = next((i for i in ids if self.shown[i]), None)
        if first is not None and first not in self.raw and joined.startswith(b" ") and first != self.unknown:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        out, run, started = [], bytearray(), False

        def flush() -> None:
            at = 0
            while at < len(run):
                for length in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + length]).decode())
                        at += length
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append(NOT_UTF8)
                    at += 1
            run.clear()

        for i in ids:
            if i in self.raw:
                run.append(self.raw[i])
                started = True
                continue
            flush()
            if self.shown[i]:
                text = self.plain[i].decode()
                out.append(text[1:] if not started and i != self.unknown and text.startswith(" ") else text)
                started = True
        flush()
        return "".join(out)

    def both_ways(self, texts: list[str], check: bool = True) -> tuple[list[list[int]], list[str]]:
        """Ids and decoded texts; with ``check`` both are compared with the library's."""
        ids = self.encode(texts, check)
        decoded = [self.decode(each) for each in ids]
        if check and decoded != self.library.decode(ids, num_threads=1):
            raise MismatchError("the library decodes a text of this batch otherwise")
        return ids, decoded


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", check: bool = True) -> DataFrame:
    """doc_id, ids and ``decoded`` text of every document.

    The text is cut where no merge can cross (see ``_chunk_pattern``), each chunk is encoded by an agenda of its
    neighbouring symbols, and chunks met before are looked up. With ``check`` every Arrow batch is compared with the
    library: the ids of each chunk when the worker meets it, the decoded texts as a whole; a difference fails the job. A null or empty text has no ids and
    decodes to an empty text. Rows that repeat an id are documents of their own; an empty table gives no rows;
    other columns are not looked at. ``model`` is a path that every executor can open. A text is held by one task;
    a chunk without spaces takes time in proportion to its length and the logarithm of it.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    ddl = f"doc_id {id_type}, ids array<int>, decoded string"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def encode(batches):
        pieces = _pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [text or "" for text in part.column("text").to_pylist()]
                ids, decoded = pieces.both_ways(texts, check)
                columns = [part.column("doc_id").cast(schema.field("doc_id").type)]
                columns += [pa.array(values, schema.field(name).type) for name, values in (("ids", ids), ("decoded", decoded))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return narrow.mapInArrow(encode, ddl)
