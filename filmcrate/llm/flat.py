"""Texts of a batch as flat numpy arrays: words, lines and polynomial hashes of either."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

U = np.uint64
#: Texts are taken together up to this many code points, so that working arrays stay near 30 MB; a longer text is taken alone.
CHUNK = 1 << 18
#: Terms from which a span's polynomial hash is replaced by a digest.
LONG = 64
_B, _C = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: What a byte counts as in a hash.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each half-open span, wherever it stands."""
    back = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` code points together, one text at least."""
    lo, have = 0, 0
    for i, t in enumerate(texts):
        if i > lo and have + len(t) > limit:
            yield lo, i
            lo, have = i, 0
        have += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Flat:
    data: np.ndarray  # UTF-8 bytes of all texts, a newline after each
    begin: np.ndarray  # of each text
    word_start: np.ndarray
    word_end: np.ndarray
    word_doc: np.ndarray
    points: np.ndarray  # code points before each byte

    def word_points(self) -> np.ndarray:
        return self.points[self.word_end] - self.points[self.word_start]


def flatten(texts: list[str], gap: np.ndarray = SPACE, data: np.ndarray | None = None) -> Flat:
    """Words are the longest runs of bytes outside ``gap`` (which holds the newline)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if data is None:
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    begin = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=begin[1:])
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~gap[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return Flat(data, begin, start, end, np.searchsorted(begin, start, side="right") - 1, points)


def strong(parts: Iterable[bytes]) -> np.ndarray:
    """A digest of each part. Polynomials modulo 2**64 have texts that collide whatever the base, from some thousand terms on; longer spans than LONG take this one."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=8).digest() for x in parts), dtype=np.uint64)


def word_hashes(flat: Flat) -> np.ndarray:
    out = span_hash(prefix(BYTES[flat.data], _B), flat.word_start, flat.word_end, _B)
    long = np.flatnonzero(flat.word_end - flat.word_start > LONG)
    if len(long):
        out[long] = strong(flat.data[a:b].tobytes() for a, b in zip(flat.word_start[long].tolist(), flat.word_end[long].tolist(), strict=True))
    return out


def gram_hashes(words: np.ndarray, doc: np.ndarray, n: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of n words inside one text; the hash holds the text's number."""
    if len(words) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    sums = prefix(words, _C) if sums is None else sums
    return first, span_hash(sums, first, first + n, _C) ^ mix(doc[first].astype(np.uint64) + U(1))


def word_sums(words: np.ndarray) -> np.ndarray:
    return prefix(words, _C)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Where keys stand that occur twice or more."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(0, dtype=np.int64)
    seen = np.zeros(1 << 16, dtype=bool)
    seen[again >> U(48)] = True
    maybe = np.flatnonzero(seen[keys >> U(48)])
    at = np.searchsorted(again, keys[maybe])
    return maybe[again[np.minimum(at, len(again) - 1)] == keys[maybe]]


def covered(n: int, first: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of ``first``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + width, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)
