"""Vectorised word and shingle hashes over batches of texts: whole texts, a few passes over their bytes, bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are taken together up to this many bytes; a longer text is taken alone, whole.
CHUNK_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_SAME = np.arange(256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, np.uint64(base), np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = out
        if size <= CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


_INVERSE = pow(int(_ODD), -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def values(column) -> Iterator[str | None]:
    """The texts of an Arrow column one by one, so that a batch is never a list of strings as well."""
    return (x.as_py() for x in column)


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of at most CHUNK_BYTES; null is the empty text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(b) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def word_spans(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, counts) of the words of texts, words being runs without ASCII blanks; counts has the number of
    words of each text."""
    buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    stops = np.cumsum([len(b) + 1 for b in encoded])
    return buf, starts, ends, np.diff(np.searchsorted(starts, stops), prepend=0)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit polynomial hashes of the words, mixed; equal for equal bytes wherever they stand."""
    n = len(buf)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(((_LOWER if lower else _SAME)[buf] + np.uint64(1)) * _power(int(_ODD), n, "p"), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n, "q")[starts])


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of its k-word shingles, A-Z lower-cased; with fewer words, of the whole sequence;
    without words, empty."""
    for _, encoded in chunks(texts):
        buf, starts, ends, counts = word_spans(encoded)
        words = word_hashes(buf, starts, ends)
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = mix(rolled * _ODD + words[j : j + len(rolled)])
        at = 0
        for c in counts.tolist():
            if c >= k:
                own = np.sort(rolled[at : at + c - k + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif c:
                h = np.zeros(1, np.uint64)
                for j in range(c):
                    h = mix(h * _ODD + words[at + j : at + j + 1])
                yield mix(h + np.uint64(c))
            else:
                yield np.zeros(0, np.uint64)
            at += c


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed 64-bit numbers."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
