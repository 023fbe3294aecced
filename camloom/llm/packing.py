"""Packing token sequences by minimum bin slack.

A document's ids fill whole sequences as long as they can; what remains, shorter than a sequence, waits in a window. A bin
takes the longest piece of the window, then the multiset of remaining lengths whose sum comes closest to the room left: a
bitset of reachable sums (bit s: some pieces sum to s) grows by each length and its count, and walking back through the
bitsets tells how many pieces of each length make the best sum. Slack that even the best sum leaves is filled by cutting a
piece. Windows live in the task that tokenizes, so nothing is shuffled, and a recomputed task gives the same sequences.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from camloom.llm.common import text_of
from camloom.llm.tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
LENGTH, END = 4096, 2
#: Pieces that wait at most, and that are left when bins have been made from them.
WINDOW, LEFT = 1024, 512
#: Distinct words that a worker remembers at most; beyond, it starts anew.
REMEMBERED = 600_000
BLOCK = 1 << 20
MARKS = b".,;:!?"
SPACE = re.compile(rb"[\t-\r ]")
#: ASCII, and letters for which the library's lower-casing and Python's are the same.
PLAIN = re.compile("[!-~À-ž]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


def byte_letters() -> dict[int, str]:
    """The letter for each byte: itself where it prints in Latin-1, else the next one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of words between ASCII white space.

    The tokenizer drops white space and never joins pieces across it, so a text's ids are those of its words in order. Words
    of plain letters are split into pieces here and the library's model encodes each; all others go through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        get = self.pieces.get
        if word.isalpha():  # most words: ASCII letters, perhaps with a mark at the end
            low = word.lower().decode()
            return self.kept(word, get(low) or self.piece(low))
        if word[:-1].isalpha() and word[-1] in MARKS:
            low, mark = word[:-1].lower().decode(), chr(word[-1])
            return self.kept(word, (get(low) or self.piece(low)) + (get(mark) or self.piece(mark)))
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text and "×" not in text and "÷" not in text and "İ" not in text:
            low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            return self.kept(word, b"".join([get(p) or self.piece(p) for p in PIECE.findall(low)]))
        return self.kept(word, packed(self.whole.encode(text, add_special_tokens=False).ids))

    def kept(self, word: bytes, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = packed([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))])
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def of(self, text: bytes) -> Iterator[bytes]:
        """A text's ids, by blocks that end at white space."""
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                m = SPACE.search(text, end)
                end = m.start() if m else len(text)
            yield b"".join(map(self.__getitem__, text[at:end].split()))
            at = end


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def closest(counts: Iterable[tuple[int, int]], room: int) -> dict[int, int]:
    """How many pieces of each (length, count), lengths at most room, to take so that their sum comes closest to room, not above it.

    Lengths are looked at only until some sum fills the room.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length, count in counts:
        count = min(count, room // length)
        trail.append((length, count, reach))
        part = 1
        while count:  # any number up to count is a sum of these parts
            part = min(part, count)
            reach |= (reach << part * length) & mask
            count -= part
            part *= 2
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, count, before in reversed(trail):
        n = next(n for n in range(count + 1) if left >= n * length and before >> (left - n * length) & 1)
        if n:
            taken[length] = n
            left -= n * length
    return taken


class Packer:
    """Sequences of one task. A piece: [document, start, ids]; rows: (document, start, length, crc, sequence, offset)."""

    def __init__(self, length: int, sequence: int) -> None:
        self.length, self.sequence, self.rows = length, sequence, []
        self.pool: dict[int, list] = {}
        self.lengths: list[int] = []  # of the pool, rising
        self.waiting = 0

    def wait(self, piece: list) -> None:
        length = len(piece[2]) // 4
        if length not in self.pool:
            self.pool[length] = []
            insort(self.lengths, length)
        self.pool[length].append(piece)
        self.waiting += 1

    def take(self, length: int) -> list:
        pieces = self.pool[length]
        out = pieces.pop()
        if not pieces:
            del self.pool[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= 1
        return out

    def place(self, pieces: list[list]) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def bins(self, left: int) -> None:
        """Full sequences, while more than left pieces wait."""
        while self.waiting > left:
            chosen = [self.take(self.lengths[-1])]
            room = self.length - len(chosen[0][2]) // 4
            fitting = ((k, len(self.pool[k])) for k in reversed(self.lengths[: bisect_right(self.lengths, room)]))
            for length, n in closest(fitting, room).items() if room else ():
                chosen += [self.take(length) for _ in range(n)]
                room -= n * length
            if room and self.pool:  # every piece left is longer than the room
                doc, start, ids = self.take(self.lengths[0])
                chosen.append([doc, start, ids[: 4 * room]])
                self.wait([doc, start + room, ids[4 * room :]])
                room = 0
            if room:
                self.tail(chosen)
            else:
                self.place(chosen)

    def tail(self, pieces: list[list]) -> None:
        """The last ids of a task, fewer than a sequence: sequences whose lengths are powers of two, which need no padding."""
        total = sum(len(p[2]) // 4 for p in pieces)
        queue = pieces[::-1]
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                room, chosen = 1 << bit, []
                while room:
                    doc, start, ids = queue.pop()
                    chosen.append([doc, start, ids[: 4 * room]])
                    if len(ids) > 4 * room:
                        queue.append([doc, start + room, ids[4 * room :]])
                    room -= len(chosen[-1][2]) // 4
                self.place(chosen)


def packed_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document, with the end id after its own, is covered by its pieces; a null or empty text is its end id alone. Cuts
    are made only where a document is longer than a sequence, where the best sum leaves slack, and in the last sequences of
    a task. Rows are documents of their own even if an id repeats or is null. sequence_id: the task's number in the upper 32
    bits. Other columns are not read; an empty table gives an empty result.
    """
    path = path or tokenizer_path(TOKENIZER)
    wanted = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), text_of(f"`{text}`").cast("binary").alias("q_text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(path), Packer(length, TaskContext.get().partitionId() << 32)
        last, kind = packed([end]), pa.int64()

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*((d[0], s, n, c, d[1], q, o) for d, s, n, c, q, o in rows), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc, held, start = [key, 0], b"", 0
                for ids in chain(words.of(x.as_buffer().to_pybytes()), [last]):
                    held += ids
                    while len(held) > 4 * length or len(held) == 4 * length and ids is last:
                        packer.place([[doc, start, held[: 4 * length]]])
                        start, held = start + length, held[4 * length :]
                doc[1] = start + len(held) // 4
                if held:
                    packer.wait([doc, start, held])
                if packer.waiting >= WINDOW:
                    packer.bins(LEFT)
            if packer.rows:
                yield out()
        packer.bins(0)
        if packer.rows:
            yield out()

    kinds = [wanted.schema["doc_id"].dataType.simpleString(), *["bigint"] * 6]
    return wanted.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def op5_packing(spark, sf_dir):
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
