"""Words of whole texts and stable 64-bit hashes of word runs, for code that runs inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MAX_CACHED = 150_000
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
GROUP_BYTES = 1_000_000
LONG_WORD = 256  # longer words are hashed one by one: the sums below are meant for short ones
MIX_1, MIX_2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text: bytes.split() parts at exactly these six bytes."""
    return data.split()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive words, in order; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, width):
        total = total * BASE + words[j : j + n]
    return mixed(total)


def hashed_words(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of each text, in order; with `lower`, of A-Z as a-z.

    All texts are hashed at once: a word's hash is the sum of its bytes times powers of a base, as the difference of
    two running sums, taken back by the power it begins with.
    """
    joined = b"\n".join(texts)
    joined = joined.translate(LOWER) if lower else joined
    data = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    powers = np.full(len(data) + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sizes = (ends - starts).astype(np.uint64)
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] ^ sizes * MIX_2)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        word = joined[starts[i] : ends[i]]
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    bounds = np.cumsum([len(x) + 1 for x in texts])[:-1]
    return np.split(hashes, np.searchsorted(starts, bounds))


def with_words(batch: pa.RecordBatch, text: int, lower: bool = False) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of a batch, each with the hashes of the words of its column `text`."""
    group, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        group.append(row)
        size += len(row[text] or b"")
        if size >= GROUP_BYTES:
            yield from zip(group, hashed_words([x[text] or b"" for x in group], lower), strict=True)
            group, size = [], 0
    if group:
        yield from zip(group, hashed_words([x[text] or b"" for x in group], lower), strict=True)
