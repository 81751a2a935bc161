"""Encoding by a SentencePiece model with the byte span of every piece, and decoding.

A text is normalised by the longest prefix that the model's compiled character map holds, and each
normalised byte remembers the source byte its prefix began at. Pieces tile the normalised text, so
their ends, looked up there, are spans of the original.

A merge never reaches over two characters that no piece holds next to each other. So a text falls
into units that are merged on their own, with the same result, and units that come again are kept.
"""

from __future__ import annotations

import array
import functools
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.scratch import without

CACHED_UNITS, CACHED_PAIRS, LONGEST_CACHED = 120_000, 500_000, 64
#: Tokens after which a batch of results leaves the worker.
TOKENS_PER_BATCH = 1 << 18
#: Kinds of pieces, kinds of models and the mark of a space: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE_MARK = "▁"
MARK = SPACE_MARK.encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message; nested messages, strings and floats as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        n = varint() if n is None else n
        yield key >> 3, data[at : at + n]
        at += n


class CharacterMap:
    """The compiled map: a double-array trie of prefixes over a block of replacements."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = array.array("I", np.frombuffer(blob, "<u4", size // 4, 4).tolist())
        self.texts = blob[4 + size :]
        self.starts = {b for b in range(256) if self._child(self._base(0, 0), b) is not None}

    def _base(self, node: int, unit: int) -> int:
        value = self.units[unit]
        return node ^ (value >> 10 << ((value & 512) >> 6))

    def _child(self, node: int, byte: int) -> int | None:
        node ^= byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] that the map holds, and its length."""
        if data[at] not in self.starts:
            return None
        node, found = self._base(0, 0), None
        for end in range(at, len(data)):
            unit = self._child(node, data[end])
            if unit is None:
                break
            node = self._base(unit, unit)
            if self.units[unit] >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, end + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(0, found[0])], found[1]


def width(lead: int) -> int:
    """Bytes of the UTF-8 character that begins with this byte."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Model:
    """A BPE model: normalisation with alignment, merges, ids, and decoding.

    Models of another kind, and models with user-defined pieces, are refused.
    """

    def __init__(self, data: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                (score,) = struct.unpack("<f", piece[2]) if 2 in piece else (0.0,)
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != BPE or any(kind == USER_DEFINED for _, _, kind in pieces):
            raise ValueError("only BPE models without user-defined pieces can be read")
        self.pieces = pieces
        self.ids = {piece: k for k, (piece, _, kind) in enumerate(pieces) if kind in (NORMAL, UNUSED)}
        order = {score: k for k, score in enumerate(sorted({pieces[k][1] for k in self.ids.values()}, reverse=True))}
        self.ranks = {piece: order[pieces[k][1]] for piece, k in self.ids.items()}
        self.unused = {piece for piece, _, kind in pieces if kind == UNUSED}
        self.unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.bytes_of = {int(piece[3:5], 16): k for k, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        self.controls = {k for k, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        charmap = normalizer.get(2, b"")
        self.map = CharacterMap(charmap) if charmap else None
        self.dummy, self.trim, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.splits_at_marks = all(not pair.endswith(SPACE_MARK) or pair == 2 * SPACE_MARK for pair in self.joined)
        self.unit_pattern = self._unit_pattern()
        self.plain = self.map is None and not self.trim and self.escape and not self.suffix and self.byte_fallback
        unknown = trainer.get(44, " ⁇ ".encode())
        self.surfaces = [
            b"" if kind == CONTROL else unknown if kind == UNKNOWN else bytes([int(piece[3:5], 16)]) if kind == BYTE
            else piece.replace(SPACE_MARK, " ").encode()
            for piece, _, kind in pieces
        ]
        marks = np.array([piece.count(SPACE_MARK) for piece, _, _ in pieces], np.int64)
        self.widths = np.array([len(piece.encode()) for piece, _, _ in pieces], np.int64)
        self.source_widths = self.widths - (len(MARK) - 1) * marks  # where every mark was a space
        #: Of pieces that are bytes: how long a character is that begins with this one, 0 inside one.
        self.byte_widths = np.full(len(pieces), -1, np.int64)
        for byte, k in self.bytes_of.items():
            self.byte_widths[k] = 0 if 0x80 <= byte < 0xC0 else width(byte)
        # Scores that are the same for different pieces, as those of runs of spaces, need the merges themselves.
        scores = [pieces[k][1] for piece, k in self.ids.items() if piece.strip(SPACE_MARK) or len(piece) == 1]
        self.simple = not self.unused and self.splits_at_marks and len(set(scores)) == len(scores)
        self.matcher = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            self.matcher.add_word(piece, (len(piece), k))
        self.matcher.make_automaton()
        self.fits: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _unit_pattern(self) -> re.Pattern:
        """Units that no merge reaches out of: letters or other characters that join, with marks of space in front."""
        if not self.splits_at_marks:
            return re.compile(".+", re.DOTALL)
        letters = {c for pair in self.joined for c in pair if c.isalpha()}
        others = {c for pair in self.joined for c in pair} - letters - {SPACE_MARK}
        if any((a in letters and b in others) or (a in others and b in letters) for a, b in self.joined):
            return re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
        runs = [f"[{''.join(map(re.escape, sorted(chars)))}]+" for chars in (letters, others) if chars]
        return re.compile(f"{SPACE_MARK}+(?:{'|'.join(runs) or '(?!)'})?|{'|'.join([*runs, '.'])}", re.DOTALL)

    # Normalisation -------------------------------------------------------------------------------

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it comes from."""
        source = text.encode()
        return self._normalized(source) if source else ("", np.zeros(1, np.int64))

    def _normalized(self, source: bytes) -> tuple[str, np.ndarray]:
        out, align, at = bytearray(), array.array("q"), 0
        space = MARK if self.escape else b" "

        def put(part: bytes) -> None:
            out.extend(part)
            align.extend([at] * len(part))

        def prefix() -> tuple[bytes, int]:
            found = self.map.longest(source, at) if self.map else None
            return found or (source[at : at + width(source[at])], width(source[at]))

        while self.trim and at < len(source):
            part, n = prefix()
            if part != b" ":
                break
            at += n
        if at == len(source):
            return "", np.array([at], np.int64)
        if self.dummy and not self.suffix:
            put(space)
        after_space = self.trim
        while at < len(source):
            part, n = prefix()
            if after_space:
                part = part.lstrip(b" ")
            if part:
                put(part.replace(b" ", space))
                after_space = self.trim and part.endswith(b" ")
            at += n
        while self.trim and out.endswith(space):
            at = align[len(out) - len(space)]
            del out[len(out) - len(space) :], align[len(out) :]
        if self.dummy and self.suffix:
            put(space)
        align.append(at)
        return out.decode(), np.array(align, np.int64)

    # Encoding ------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end of each piece in the bytes of the text.

        Of the bytes of an unknown character all but the last have an empty span at its begin.
        """
        text = text or ""
        if self.plain and text and SPACE_MARK not in text:
            # The only changes are marks for spaces and one in front: the alignment has a closed form.
            ids = self._ids(SPACE_MARK * self.dummy + text.replace(" ", SPACE_MARK))
            ends = np.cumsum(self._spread(ids, self.source_widths)) - self.dummy
            return ids, np.concatenate([np.zeros(1, np.int64), ends[:-1]]), ends
        normal, align = self.normalized(text)
        ids = self._ids(normal)
        ends = np.cumsum(self._spread(ids, self.widths))
        begins = np.concatenate([np.zeros(1, np.int64), ends])[: len(ids)]
        ids = np.where(ids < 0, self.unknown, ids)
        if not self.byte_fallback and len(ids):  # unknown pieces in a row are one
            alone = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
            last = np.append(alone[1:], True)
            ids, begins, ends = ids[alone], begins[alone], ends[last]
        return ids, align[begins], align[ends]

    def _ids(self, normal: str) -> np.ndarray:
        """Ids of a normalised text; an unknown character c is -1 - c where no bytes stand for it."""
        known, found = self.units, self._unit
        return np.frombuffer(b"".join([known[u] if u in known else found(u) for u in self.unit_pattern.findall(normal)]), np.int32)

    def _spread(self, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Width of each piece; the width of a character in bytes stands at its last one."""
        lost = ids < 0
        out = widths[np.where(lost, 0, ids)]
        if lost.any():
            out[lost] = [len(chr(-1 - k).encode()) for k in ids[lost].tolist()]
        lengths = self.byte_widths[np.where(lost, self.unknown, ids)]
        if (lengths >= 0).any():
            leads = np.flatnonzero(lengths > 0)
            out[lengths >= 0] = 0
            out[leads + lengths[leads] - 1] = lengths[leads]
        return out

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit. Units of two generations are kept; one that comes again stays."""
        ids = self.older.get(unit)
        if ids is None:
            ids = self._chained(unit) if self.simple and 2 * SPACE_MARK not in unit else None
            if ids is None:
                cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.joined]
                ids = b"".join([self._merged(unit[a:b]) for a, b in zip([0, *cuts], [*cuts, len(unit)])])
        if len(unit) <= LONGEST_CACHED:
            if len(self.units) >= CACHED_UNITS:
                self.older, self.units = self.units, {}
            self.units[unit] = ids
        return ids

    def _merged(self, part: str) -> bytes:
        """Ids of a part after all merges: best score first, of equal ones that furthest left."""
        made: dict[str, tuple[str, str]] = {}
        stack = (self._merge_short if len(part) <= LONGEST_CACHED else self._merge_long)(part, made)
        if not made:
            try:
                return array.array("i", [self.ids[s] for s in stack]).tobytes()
            except KeyError:
                pass  # a character that the model doesn't have
        ids = array.array("i")
        stack.reverse()
        while stack:
            piece = stack.pop()
            if piece in made:
                stack.extend(reversed(made[piece]))
                continue
            k = self.ids.get(piece)
            if k is not None:
                ids.append(k)
            elif self.byte_fallback:
                ids.extend(self.bytes_of[byte] for byte in piece.encode())
            else:
                ids.append(-1 - ord(piece))
        return ids.tobytes()

    def _chained(self, part: str) -> bytes | None:
        """The merges' result without merging; None where a character is no piece.

        Pieces in a row are the merges' result for their text if and only if each two neighbours are
        theirs. So from the last piece of each shorter prefix follows that of the next: the piece that
        ends there and goes with the one before it.
        """
        last: list[tuple[int, int] | None] = [None] * len(part)
        fits, all_pieces = self.fits, len(self.pieces)
        for end, piece in self.matcher.iter(part):
            if last[end] is None:
                at = end - piece[0]
                if at < 0:
                    last[end] = piece
                elif (before := last[at]) is not None:
                    key = before[1] * all_pieces + piece[1]
                    fit = fits.get(key)
                    if fit is None:
                        fit = self._fits(before[1], piece[1], key)
                    if fit:
                        last[end] = piece
        ids, at = [], len(part) - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                return None
            ids.append(piece[1])
            at -= piece[0]
        ids.reverse()
        return array.array("i", ids).tobytes()

    def _fits(self, a: int, b: int, key: int) -> bool:
        """Do the merges turn the text of the two pieces into just these?"""
        one, two = self.pieces[a][0], self.pieces[b][0]
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[key] = found = self._merge_short(one + two, {}) == [one, two]
        return found

    def _merge_short(self, part: str, made: dict[str, tuple[str, str]]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        symbols = list(part)
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            pair = symbols[k] + symbols[k + 1]
            if self.unused:
                self._remember(pair, symbols[k], symbols[k + 1], made)
            symbols[k : k + 2] = [pair]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(symbols[k - 1] + pair, none)
            if k < len(ranks):
                ranks[k] = rank(pair + symbols[k + 1], none)
        return symbols

    def _merge_long(self, part: str, made: dict[str, tuple[str, str]]) -> list[str]:
        rank, symbols = self.ranks.get, list(part)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        queue: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(symbols):
                pair = symbols[a] + symbols[b]
                k = rank(pair)
                if k is not None:
                    heapq.heappush(queue, (k, a, pair))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, a, pair = heapq.heappop(queue)
            b = right[a]
            # Neighbours that changed since make another string; if not, nothing was merged.
            if not symbols[a] or b >= len(symbols) or symbols[a] + symbols[b] != pair:
                continue
            if self.unused:
                self._remember(pair, symbols[a], symbols[b], made)
            symbols[a], symbols[b] = pair, ""
            right[a] = right[b]
            if right[a] < len(symbols):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def _remember(self, pair: str, a: str, b: str, made: dict[str, tuple[str, str]]) -> None:
        """How an unused piece is taken apart again: the split seen last holds."""
        if pair in self.unused:
            made[pair] = (a, b)

    # Decoding ------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no character become U+FFFD each, the dummy space goes."""
        ids = np.asarray(ids, np.int32).tolist()
        joined = b"".join([self.surfaces[k] for k in ids])[self._front(ids) :]
        if self.controls.isdisjoint(ids):
            return joined.decode("utf-8", "each_byte")
        parts, skip = [b""], self._front(ids)
        for k in ids:  # bytes on both sides of a control piece form no character
            if k in self.controls:
                parts.append(b"")
            else:
                parts[-1] += self.surfaces[k][skip:]
                skip = max(0, skip - len(self.surfaces[k]))
        return "".join([part.decode("utf-8", "each_byte") for part in parts])

    def _front(self, ids: list[int]) -> int:
        """Leading space bytes that are no text: one, or all where the model trims white space."""
        if not (self.dummy or self.trim) or self.suffix:
            return 0
        n = 0
        for k in ids:
            piece, _, kind = self.pieces[k]
            if kind == CONTROL:
                continue
            if kind not in (NORMAL, UNUSED) or not piece.startswith(SPACE_MARK):
                break
            n += 1
            if not self.trim or piece != SPACE_MARK:
                break
        return n


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


@functools.lru_cache(maxsize=2)
def model(path: str | None) -> Model:
    import codecs

    codecs.register_error("each_byte", _each_byte)
    with open(path or default_path(), "rb") as file:
        return Model(file.read())


def encoded(df: DataFrame, text: str = "text", path: str | None = None, back: bool = False) -> DataFrame:
    """The frame with `ids`, `starts` and `ends` of the pieces of every whole text.

    With `back` also `decoded`, the text that decoding these ids gives.

    starts and ends are byte offsets in the UTF-8 of the original text, end exclusive. A null text is
    an empty one: no pieces. Repeated rows are kept; no rows, no rows. The new columns take the
    place of columns of those names, in any case. Other columns are carried along whole.
    """
    lists, texts = ["ids", "starts", "ends"], ["decoded"] * back
    kept = without(df, *lists, *texts)
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def encode(batches):
        own = model(path)
        for batch in batches:
            first, rows, tokens = 0, [], 0
            for k, value in enumerate(batch.column(1)):
                rows.append(own.encode(value.as_py()))
                tokens += len(rows[-1][0])
                if tokens >= TOKENS_PER_BATCH or k == batch.num_rows - 1:
                    more = [pa.array([own.decode(r[0]) for r in rows], pa.string())] * back
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *_lists(rows), *more], names=["row", *lists, *texts])
                    first, rows, tokens = k + 1, [], 0

    kinds = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists] + [T.StructField(c, T.StringType()) for c in texts]
    found = whole.mapInArrow(encode, T.StructType([whole.schema["row"], *kinds]))
    return found.select(*[F.col(f"row.`{c}`") for c in kept.columns], *lists, *texts)


def _lists(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    offsets = pa.array(np.cumsum([0, *[len(r[0]) for r in rows]]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in range(3)]


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids. Null gives null; an id that the model doesn't have raises an error."""
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        own = model(path)
        return pa.array([own.decode(v.values) if v.is_valid else None for v in column], pa.string())

    return decode(ids)
