"""Token ids of whole texts, by the files of public tokenizers, with a cache of words."""

from __future__ import annotations

import array
import functools
import re
import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

CACHED_WORDS, CACHED_PARTS = 200_000, 300_000
LONGEST_CACHED = 64
#: Letters that stand alone under NFC and have a lower case of one letter, then ASCII marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Python splits at these as well; the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes a text as the joined ids of its words.

    For tokenizers whose pre-tokens never reach over white space, which is dropped: then the ids
    of a text are those of its words in a row. Words of plain letters and trailing marks are taken
    apart once more, so that a word is encoded once whatever its case and punctuation.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_path())
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x41, 0x100) if PLAIN.fullmatch(chr(c)) and chr(c).isalpha()]
        self.letters = str.maketrans({c: level.pre_tokenize_str(c.lower())[0][0] for c in letters})
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for a null or empty text."""
        if not text:
            return b""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        words = text.split() if SEPARATORS.search(text) is None else SPACE.split(text)
        known = self.words
        return b"".join([known[w] if w in known else self._word(w) for w in words])

    def _word(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if not plain:
            return self._kept(word, self._encoded(word))
        letters, marks = plain.groups()
        mapped = letters.translate(self.letters)
        out = self.parts.get(mapped)
        if out is not None:  # letters that were seen before: the word may come again
            return self._kept(word, out + (self._part(marks) if marks else b""))
        out = packed(t.id for t in self.tokenizer.model.tokenize(mapped))
        if len(letters) <= LONGEST_CACHED:
            self.parts[mapped] = out
        return out + (self._part(marks) if marks else b"")

    def _kept(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST_CACHED:
            self.words[word] = ids
        return ids

    def _part(self, marks: str) -> bytes:
        out = self.parts.get(marks)
        if out is None:
            out = self._encoded(marks)
            if len(marks) <= LONGEST_CACHED:
                self.parts[marks] = out
        return out

    def _encoded(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def packed(ids) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str | None = None,
                      extra: int = 0) -> DataFrame:
    """The frame with the number of tokens of each text, plus `extra`; a null text counts as empty.

    `name` takes the place of a column of that name.
    """
    from pyspark.sql import functions as F

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path).ids
        return pa.array([len(encode(t.as_py())) // 4 + extra for t in texts], pa.int64())

    return df.withColumn(name, count(F.col(text)))


def pieces(df: DataFrame, key: str, text: str, longest: int, end_id: int | None = 0, path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every text, cut into pieces of at most `longest` ids.

    A text is its ids and then `end_id`, where one is given. A null text is an empty one. Without an
    end id an empty text has no piece.
    """
    kind = df.schema[key].dataType.simpleString()
    end = packed([end_id]) if end_id is not None else b""
    step = 4 * longest

    def cut(batches):
        encode = encoder(path).ids
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = encode(value.as_py()) + end
                for number, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return df.select(key, text).mapInArrow(cut, schema)
