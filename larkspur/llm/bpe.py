"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder walks a piece of bytes with the longest vocabulary token that starts at each place, found by an Aho-Corasick
automaton, and takes it only if it is compatible with the token before it: a pair is compatible if encoding the joined bytes of the two by merges
gives just these two. If not, the next shorter token is tried, and where none is left the last token is taken back. Places
known to lead nowhere are marked, so the work is linear, and the result is that of the merges. Pairs judged are kept in a table.

The vocabulary is given as ranks, ids in order of merging, with the pattern that cuts a text into pieces; nothing is trained. For
the usual pattern, texts are first cut, over whole slices of a column at once, at places where a piece ends in any case: before white
space that follows a word, after a single line end, and before ASCII punctuation that follows an ASCII letter or digit. Equal parts, told by a hash of
64 bits, are encoded once. The tokens of a slice are decoded and held against its bytes, so a collision of hashes can't go unseen: such a
slice is encoded text by text.

Defined results: a null text has null tokens and decodes to null; an empty one has none and decodes to the empty text; ids that are null or not in the vocabulary
decode to the replacement character each; a very long text is encoded in slices that end where a part ends; other columns pass through, and a result gets a longer name where one has its.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .words import U64, mix, powers, split_rows, text_buffers

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Used unless the parameter names another file; it is read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Parts of texts remembered by a task, and bytes of text encoded at once.
REMEMBERED, SLICE = 400_000, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _set(*codes: object) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in codes:
        out[c] = True
    return out


_SPACE, _CONTROL = _set(slice(9, 14), 32), _set(slice(28, 32))
_ALNUM, _PUNCTUATION = _set(slice(48, 58), slice(65, 91), slice(97, 123)), _set(slice(33, 48), slice(58, 65), slice(91, 97), slice(123, 127))
#: Bytes that may begin, and that may be the first of three of, white space beyond ASCII.
_WIDE, _WIDE3 = _set(0xC2, 0xE1, 0xE2, 0xE3), _set(0xE1, 0xE2, 0xE3)


def cuts(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where parts begin in rows of text laid end to end, each row beginning one."""
    cut = np.zeros(len(raw), bool)
    cut[rows[:-1][rows[:-1] < len(raw)]] = True
    before, at = raw[:-1], raw[1:]
    wide = np.zeros(len(before), bool)
    wide[1:] = (raw[:-2] == 0xC2) & ((before[1:] == 0xA0) | (before[1:] == 0x85))
    wide[2:] |= _WIDE3[raw[:-3]]
    cut[1:] |= _SPACE[at] & ~(_SPACE[before] | _CONTROL[before] | wide)
    # of longer white space the last character goes apart only if a word follows
    cut[1:] |= _SPACE[before] & (before != 32) & ~(_SPACE[at] | _CONTROL[at] | _WIDE[at]) & cut[:-1]
    cut[1:] |= _ALNUM[before] & _PUNCTUATION[at]
    return np.flatnonzero(cut)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of lines "base64 rank", by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [t for _, t in pairs]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.by_bytes = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((self.by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.by_bytes), -1) for t in tokens]
        self.merged: dict[int, int] = {}
        self.parts: list[tuple[int, int]] = []
        self.judged: dict[int, bool] = {}
        for i, t in enumerate(tokens):
            self.parts.append(self._halves(i, t))
        self.judged.clear()
        self.known: dict[int, tuple[int, ...]] = {}
        self.decoder = Decoder(tokens)

    def _halves(self, i: int, token: bytes) -> tuple[int, int]:
        """The two lower tokens that merge into this one; itself twice if there are none."""
        a = self.shorter[i]
        while a >= 0:
            b = self.by_bytes.get(token[self.lengths[a] :], i)
            if a < i and b < i and self._judge(a, b):
                self.merged[a << 32 | b] = i
                return a, b
            a = self.shorter[a]
        return i, i

    def _judge(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the border, latest first: no earlier merge may join tokens across it."""
        limit, parts, merged = 1 << 60, self.parts, self.merged
        while True:
            if merged.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.judged.get(a << 32 | b)
        if found is None:
            if len(self.judged) > REMEMBERED:
                self.judged.clear()
            found = self.judged[a << 32 | b] = self._judge(a, b)
        return found

    def piece(self, raw: bytes) -> list[int]:
        """The tokens of one piece."""
        n = len(raw)
        longest = [-1] * (n + 1)
        lengths = self.lengths
        for end, i in self.automaton.iter(raw.decode("latin-1")):  # matches come by their ends: the last one that begins at a place is its longest
            longest[end + 1 - lengths[i]] = i
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.lengths[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = self.shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_[at] = 0
                token = out.pop()
                at -= self.lengths[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.piece(p.encode()) for p in self.pattern.findall(text)))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of each text begin, and all tokens."""
        rows, raw = text_buffers(column)
        at, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for a, b in split_rows(rows, SLICE):
            if rows[b] - rows[a] <= 2 * SLICE:
                begin, ids = self.encode_rows(rows[a : b + 1] - rows[a], raw[rows[a] : rows[b]])
            else:  # one long text
                found = [self.encode_rows(np.array([0, z - y]), raw[y:z])[1] for y, z in self._slices(raw, int(rows[a]), int(rows[b]))]
                ids = np.concatenate(found)
                begin = np.array([0, len(ids)])
            at.append(begin[1:] + at[-1][-1])
            parts.append(ids)
        return np.concatenate(at), np.concatenate(parts)

    def _slices(self, raw: np.ndarray, a: int, z: int) -> Iterator[tuple[int, int]]:
        """Ranges of a text, each ending where a part ends."""
        most = SLICE
        while a < z:
            end = min(a + most, z)
            if end < z:
                found = cuts(raw[a:end], np.array([0, end - a])) if self.pattern.pattern == PATTERN else np.zeros(0, np.int64)
                found = found[found > 3]
                if not len(found):
                    most *= 2
                    continue
                end = a + int(found[-1])
            yield a, end
            a, most = end, SLICE

    def encode_rows(self, rows: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of each row of text begin, and all tokens."""
        if not len(raw):
            return np.zeros(len(rows), np.int64), np.zeros(0, np.int32)
        starts = cuts(raw, rows) if self.pattern.pattern == PATTERN else np.unique(rows[:-1][np.diff(rows) > 0])
        ends = np.append(starts[1:], len(raw))
        power, inverse = powers(_BASE, len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power, out=total[1:])
        hashes, first, at = np.unique(mix((total[ends] - total[starts]) * inverse[starts]), return_index=True, return_inverse=True)
        blob, known, found = raw.tobytes(), self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for h, a, b in zip(hashes.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = tuple(self.encode(blob[a:b].decode()))
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        size, begin = sizes[at], (np.cumsum(sizes) - sizes)[at]
        token_at = np.concatenate([[0], np.cumsum(size)])
        tokens = flat[np.repeat(begin - token_at[:-1], size) + np.arange(token_at[-1])]
        if not np.array_equal(self.decoder.decode(tokens)[0], raw):
            each = [self.encode(blob[a:b].decode()) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            return np.cumsum([0, *map(len, each)]), np.fromiter(chain.from_iterable(each), np.int32)
        return token_at[np.searchsorted(starts, rows)], tokens


class Decoder:
    """All tokens' bytes one after another, and where each begins; the last is what an unknown id stands for."""

    def __init__(self, tokens: list[bytes]) -> None:
        tokens = [*tokens, "\ufffd".encode()]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum([0, *map(len, tokens)])

    def known(self, ids: np.ndarray) -> np.ndarray:
        """The ids, with that of the replacement character for any that isn't in the vocabulary."""
        last = len(self.at) - 2
        return np.where((ids >= 0) & (ids < last), ids, last)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and where each token's begin."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        begin = ends - size
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.at[ids] - begin, size) + np.arange(total)], np.append(begin, total)


_encoders: dict[tuple, Encoder] = {}
_decoders: dict[int, Decoder] = {}


def _decoder(tokens: list[bytes]) -> Decoder:
    key = hash(tuple(tokens))
    if key not in _decoders:
        _decoders[key] = Decoder(tokens)
    return _decoders[key]


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    key = (len(tokens), tokens[-1], hash(tuple(tokens)), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", name: str = "tokens") -> DataFrame:
    """A column of token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("array<int>")
    def tokens(column: pa.Array) -> pa.Array:
        at, ids = _encoder(shared.value, pattern).encode_column(column)
        null = pa.array(column.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=null)

    return docs.withColumn(free_name(docs, name), tokens(F.col(text)))


def decode(docs: DataFrame, vocabulary: str = VOCABULARY, tokens: str = "tokens", name: str = "decoded") -> DataFrame:
    """A column of the text of token ids; bytes that aren't UTF-8 become the replacement character."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        d = _decoder(shared.value)
        out = []
        for x in column:
            out.append(d.decode(d.known(x.values.fill_null(-1).to_numpy(zero_copy_only=False)))[0].tobytes().decode("utf-8", "replace") if x.is_valid else None)
        return pa.array(out, pa.string())

    return docs.withColumn(free_name(docs, name), texts(F.col(tokens)))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoded = encode(slim, vocabulary).select("doc_id", "tokens")
    return decode(encoded, vocabulary).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", "decoded")
