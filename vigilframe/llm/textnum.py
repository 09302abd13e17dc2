"""Words of many texts as 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Bytes of text worked on at once: a bound on memory.
CHUNK = 1 << 20
#: Longer words are hashed by XXH64: sums of powers of an odd base repeat for long words of a regular build.
SHORT = 24
_BASE = 0x9E3779B97F4A7C15
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(0, 2**64, 256, np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation, for words without their punctuation.
_BREAK = _SPACE.copy()
_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a public 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


END = int(mix(np.array([1], np.uint64))[0])
BEGIN = int(mix(np.array([2], np.uint64))[0])


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        step, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers, _inverse = np.cumprod(step), np.cumprod(back)


def _hash_words(flat: bytes, breaks: np.ndarray = _SPACE, heads: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word, and of its first bytes for each length in heads that is below its own."""
    a = np.frombuffer(flat, np.uint8)
    word = ~breaks[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    _grow(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _powers[: len(a)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > SHORT):
        h[i] = xxhash.xxh64_intdigest(flat[starts[i] : ends[i]], 42)
    found, at = [h], [starts]
    for n in heads:
        longer = starts[ends - starts > n]
        found.append(mix((sums[longer + n] - sums[longer]) * _inverse[longer] + np.uint64(n << 32)))
        at.append(longer)
    return np.concatenate(found), np.concatenate(at)


def _segments(text: bytes) -> Iterator[bytes]:
    """A very long text in parts that end at white space where there is any."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t"))
            if cut > at:
                end = cut + 1
            else:
                following = [x for x in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(following, default=len(text))
        yield text[at:end]
        at = end


def word_hashes(texts: Sequence[bytes | None], lower: bool = True, punctuation: bool = True, heads: Sequence[int] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, doc, hash) for runs of texts: doc numbers them from first; hash of each word in order.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased if lower; null has none.
    Without punctuation, ASCII punctuation parts words as white space does.
    heads adds hashes of the words' first bytes after the words, out of order.
    """
    case, breaks = bytes.lower if lower else bytes, _SPACE if punctuation else _BREAK
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= CHUNK):
            size += len(texts[j] or b"") + 1
            j += 1
        if size > CHUNK + 1:  # one text
            found = [_hash_words(x, breaks, heads)[0] for x in _segments(case(texts[i] or b""))]
            h = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield i, np.zeros(len(h), np.int64), h
        else:
            h, starts = _hash_words(case(b"\n".join(t or b"" for t in texts[i:j])), breaks, heads)
            bounds = np.cumsum([len(t or b"") + 1 for t in texts[i:j]])
            yield i, np.searchsorted(bounds, starts, side="right"), h
        i = j
