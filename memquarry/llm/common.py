"""What the operators of this subpackage share: tables that cut lineage, token hashing and pre-tokens."""

from __future__ import annotations

import base64
import bisect
import ctypes
import gc
import os
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from memquarry.session import ship, written  # noqa: F401  (the operators take written from here)

TOKENIZER_DIR = os.environ.get("MEMQUARRY_TOKENIZERS", "/opt/tokenizers")

#: Splits a text into the pre-tokens that the byte-level vocabularies merge within.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def mapped(df: DataFrame, make, schema) -> DataFrame:
    """df.mapInArrow by functions of this package, which the workers are given. A worker serves many tasks: after each it gives free memory back, and collects garbage again where a task had that switched off."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from make(batches)
        finally:
            _tidy()

    return df.mapInArrow(run, schema)


def _tidy() -> None:
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_of(keys: np.ndarray) -> np.ndarray:
    """The places of uint64 keys in their order, equal ones in order of place where keys and places fit in one word; sorting such words is many times faster than an argsort."""
    if len(keys) < 2:
        return np.arange(len(keys))
    spread, bits = keys - keys.min(), (len(keys) - 1).bit_length()
    drop = max(0, int(spread.max()).bit_length() + bits - 64)
    words = (spread >> np.uint64(drop)) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    words.sort()
    order = (words & np.uint64((1 << bits) - 1)).astype(np.int64)
    if drop:
        sorted_keys = keys[order]
        if (sorted_keys[1:] < sorted_keys[:-1]).any():
            order = order[np.argsort(sorted_keys, kind="stable")]
    return order


_CHARACTERS: list = []


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point whether it belongs to a word (as re's \\w) and a random number; by place in a word a random odd number."""
    if not _CHARACTERS:
        every = np.arange(0x110000, dtype=np.uint64)
        inside = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        inside[ord("_")] = True
        _CHARACTERS.extend((inside, mix64(every + np.uint64(0x2545F4914F6CDD1D)), _place_numbers(1 << 10)))
    return tuple(_CHARACTERS)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run of re's \\w) of the lower-cased texts, in order, and how many words each text has; none for a null text. All characters of all texts are taken at once."""
    inside = _characters()[0]
    lowered = [t.lower() if t else "" for t in texts]
    c = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate(([False], inside[c], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    stops = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    c = c[word[1:-1]]
    return mix64(character_sums(c, np.cumsum(sizes) - sizes, sizes) + sizes.astype(np.uint64)), counts


def character_sums(c: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of the runs that make up the characters c the sum, over its characters, of a random number of the character times one of its place."""
    _, of_character, of_place = _characters()
    if not len(starts):
        return np.empty(0, np.uint64)
    if (most := int(sizes.max())) > len(of_place):
        of_place = _place_numbers(most)
    return np.add.reduceat(of_character[c] * of_place[np.arange(len(c)) - np.repeat(starts, sizes)], starts)


def _place_numbers(n: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length of numbers that aren't negative, each with as many bytes a number as its largest needs."""
    parts = [np.uint64(len(columns[0])).tobytes()]
    for column in columns:
        wide = np.ascontiguousarray(column, "<u8")
        width = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
        parts += [bytes([width]), wide.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of pack() as uint64."""
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    while at < len(data):
        width = data[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(n, width)
        out.append(wide.view("<u8").reshape(-1))
        at += 1 + n * width
    return out


#: Characters of text that a worker takes apart at once.
SLICE = 6_000_000


class BoundedCache(dict):
    """A dict that computes what it lacks; trim() empties it once it holds more than `most` entries, so that a worker's memory stays bounded."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def token_hashes(most: int = 400_000) -> BoundedCache:
    return BoundedCache(xxhash.xxh64_intdigest, most)


_MODEL: dict = {}


def only_model(key, make):
    """What make() gives, kept for a worker's next tasks with the same key; a worker holds one vocabulary at a time."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]


def byte_ranks(path: str):
    """The rank file's vocabulary as a tiktoken encoding; no special tokens, so that any text is ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile("[\0-\u024f]*")
_LATIN_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def pre_tokens():
    """text -> its pre-tokens, which joined give the text. Texts of Latin characters take the same pattern spelt out, which is faster."""
    latin, quick, other = _LATIN.fullmatch, _LATIN_PRE_TOKEN.findall, regex.compile(PRE_TOKEN).findall
    return lambda text: quick(text) if latin(text) else other(text)


def regrouped(batches, text: int, most_chars: int = SLICE):
    """Consecutive batches joined until their texts hold most_chars bytes; for work whose cost falls with the number of texts seen at once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= most_chars:
            yield from _joined(held)
            held, size = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list):
    return held if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(texts: list, most_chars: int = SLICE):
    """(start, stop) of consecutive rows with at most `most_chars` characters together, or one row; keeps a worker's memory bounded whatever the batch."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > start and held + size > most_chars:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def disjoint(spans, start, end) -> list:
    """The spans, given in the order of preference, that overlap none taken before."""
    starts, ends, out = [], [], []
    for s in spans:
        a, b = start(s), end(s)
        i = bisect.bisect_right(starts, a)
        if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append(s)
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of pool[s : s + n] over starts and lengths."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(total)]
