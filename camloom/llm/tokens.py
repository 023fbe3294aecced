"""Token counts by prefix dynamic programming.

A sequence of pieces is what the library gives for its text just if each two neighbours are what it gives for theirs, and no
text has two such sequences. So the encoding of a prefix ends in the one piece that fits after the encoding of what is before
it: count(prefix) = count(prefix without that piece) + 1. Which pieces fit after which is asked of the library once for each
pair; a character in no piece ends what was before it and counts its bytes.

No piece of the vocabulary has a space after another character, and a line feed is in none, so no merge crosses the place
before a space run or beside a line feed. A text, with the space that the library puts before it, falls there into segments,
which repeat: the counts of a segment's prefixes are worked out once a worker. The table of a text has the exact count at every
prefix (characters), so counts, budgets and truncation points are read from it and nothing is encoded again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from camloom.llm.common import text_of, written

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct segments that a worker remembers at most, and pairs of pieces; beyond, it starts anew.
REMEMBERED = 1 << 19
#: Characters of text whose segments are listed, and counts sent, at once; a single text's table may be larger.
BLOCK = 1 << 20
SEGMENT = re.compile(r"\n| *[^ \n]+| +")
#: The library writes a space as this character, so one in a text is a space to it.
MARK = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounts:
    """Token counts at every prefix of a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        plain = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        if any("\n" in p or re.search("[^▁]▁", p) for p in plain):
            raise ValueError("this vocabulary has pieces across spaces or line feeds; segments would not be independent")
        self.pieces, self.longest = set(plain), max(map(len, plain))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def fits(self, before: str, piece: str) -> bool:
        """Whether the library gives these two pieces, or with nothing before this one, for their text."""
        # A line feed first, so that there is no space put before the text.
        given = self.model.encode("\n" + (before + piece).replace(MARK, " "), out_type=str)
        return given[given.index("<0x0A>") + 1 :] == [p for p in (before, piece) if p]

    def learn(self, segments: set[str]) -> None:
        """Works out what each character of these segments adds to the count, as 32-bit numbers in ``known``.

        In order, so that a segment goes on from what it shares with the one before it.
        """
        if len(self.known) + len(segments) > REMEMBERED:
            self.known.clear()
        pieces, pairs, most = self.pieces, self.pairs, self.longest
        counts, last, added, previous = [0], [""], [], ""
        for segment in sorted(x for x in segments if x not in self.known):
            s = segment.replace(" ", MARK)
            if len(pairs) > REMEMBERED:
                pairs.clear()
            same = len(commonprefix((previous, s)))
            del counts[same + 1 :], last[same + 1 :], added[same:]
            for end in range(same + 1, len(s) + 1):
                if s[end - 1] not in pieces:
                    now, piece = counts[-1] + len(s[end - 1].encode()), ""
                else:
                    for start in range(end - most if end > most else 0, end):
                        piece = s[start:end]
                        if piece in pieces:
                            pair = last[start], piece
                            fits = pairs.get(pair)
                            if fits is None:
                                fits = pairs[pair] = self.fits(*pair)
                            if fits:
                                now = counts[start] + 1
                                break
                    else:
                        raise ValueError(f"no piece ends the prefix {s[:end]!r}")
                added.append(now - counts[-1])
                counts.append(now)
                last.append(piece)
            self.known[segment] = array("i", added).tobytes()
            previous = s

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts at its prefixes: of its first character, its first two, ..."""
        parts = [[SEGMENT.findall(part) for part in blocks(text)] for text in texts]
        self.learn({segment for text in parts for part in text for segment in part})
        out = []
        for text in parts:
            added = np.frombuffer(b"".join([b"".join(map(self.known.__getitem__, part)) for part in text]), np.int32)
            out.append(np.cumsum(added, dtype=np.int32)[1:])
        return out


def blocks(text: str) -> Iterator[str]:
    """The text with the space before it, in parts from BLOCK characters each, cut before a space run or line feed."""
    if not text:
        return
    text, at = " " + text.replace(MARK, " "), 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not (text[end] in " \n" and text[end - 1] != " "):
            end += 1
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def prefix_tables(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """carry's columns with n_bytes and prefix_tokens: the token counts of each row's text cut after each of its characters.

    Null texts count as empty: 0 bytes, an empty table. Special strings inside texts are ordinary text, as the library has it.
    Rows are independent, so repeated ones get equal tables and an empty table of rows an empty one. A carried column named
    like an output is replaced by it. path: a sentencepiece BPE model, which each worker opens.
    """
    path = path or tokenizer_path(MODEL)
    carry = [c for c in carry if c.lower() not in ("n_bytes", "prefix_tokens")]
    t = text_of(f"`{text}`")
    wanted = docs.select(*(docs[f"`{c}`"] for c in carry), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            first, texts, size = 0, [], 0
            for k, x in enumerate(b.column(b.num_columns - 1)):
                texts.append(x.as_py())
                size += len(texts[-1])
                if size >= BLOCK or k + 1 == b.num_rows:
                    tables = counter.tables(texts)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in tables])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tables)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in b.columns[:-1]), lists], names=[*carry, "n_bytes", "prefix_tokens"])
                    first, texts, size = k + 1, [], 0

    return wanted.mapInArrow(run, wanted.drop("q_text").schema.add("prefix_tokens", ArrayType(IntegerType())))


def tokens_in(table: Column) -> Column:
    """Tokens of the whole text, from its table."""
    return F.when(F.size(table) == 0, 0).otherwise(F.element_at(table, -1)).cast("long")


def tokens_before(table: Column, chars: Column) -> Column:
    """Tokens of the text cut after so many characters, from its table; beyond its end, of all."""
    return F.when((chars <= 0) | (F.size(table) == 0), 0).otherwise(F.element_at(table, F.least(chars, F.size(table)).cast("int"))).cast("long")


def chars_within(table: Column, budget: int | Column) -> Column:
    """The most characters that the text can be cut after with no more than budget tokens, from its table."""
    fitting = F.array_max(F.transform(table, lambda n, k: F.when(n <= budget, k + 1)))
    return F.when(tokens_in(table) <= budget, F.size(table)).otherwise(F.coalesce(fitting, F.lit(0))).cast("long")


#: Counts rise slowly: written as packed differences, a table takes a fraction of its text.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def token_counts(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """carry's columns with n_bytes, n_tokens, over_limit and kept_chars of every row's whole text.

    The tables of all texts are written first; everything is answered from them. kept_chars: the most characters within the
    limit. Nulls, empties, repeats and clashing names as in ``prefix_tables``.
    """
    named = ("n_bytes", "n_tokens", "over_limit", "kept_chars")
    carry = [c for c in carry if c.lower() not in (*named, "prefix_tokens")]
    table = written(prefix_tables(docs, carry, text, path), "prefixes", PACKED)
    n = tokens_in(F.col("prefix_tokens"))
    return table.select(*(F.col(f"`{c}`") for c in carry), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), chars_within(F.col("prefix_tokens"), limit).alias("kept_chars"))


def op6_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
