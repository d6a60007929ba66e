"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A text's words get the
same hashes wherever and in whatever company the text is processed. Work is done in pieces of PIECE bytes, cut at
white space, so the memory in use does not depend on how long a text is (8 bytes per word are kept).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

# Small: a piece's arrays are 8 bytes for each byte of text, several of them at a time, in every Python worker of an executor.
PIECE = 1 << 18
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    return mix(np.full(n, seed * 0x9E3779B97F4A7C15 % (1 << 64), _U) + np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = stream(11, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(n, base, _U)
        p[0] = 1
        have = _powers[name] = np.cumprod(p)
    return have[:n]


def _piece(buf: np.ndarray, prefix: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (or their prefixes) in a buffer that begins and ends between words, and where they start."""
    sp = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sp, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if prefix:
        end = np.minimum(end, start + prefix)
    n = len(buf) + 1
    acc = np.zeros(n, _U)
    np.cumsum(_BYTE[buf] * _power(_BASE, n, "up")[:-1], out=acc[1:])
    down = _power(pow(_BASE, -1, 1 << 64), n, "down")
    return mix((acc[end] - acc[start]) * down[start] + (end - start).astype(_U)), start


def _cuts(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while len(buf) - at > PIECE:
        step = 0
        while True:  # the last white space of the piece; a longer word stretches the piece
            lo = at + step
            found = np.flatnonzero(_SPACE[buf[lo : at + PIECE + step]])
            if len(found):
                to = lo + int(found[-1]) + 1
                break
            step += PIECE
            if at + step >= len(buf):
                to = len(buf)
                break
        yield at, to
        at = to
    yield at, len(buf)


def word_hashes(texts: Sequence[str | None], table: bytes | None = None, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts one after another, offsets: text i has offsets[i]:offsets[i+1]).

    `table` (256 bytes) replaces bytes first, e.g. punctuation by spaces; `prefix` hashes that many bytes of a word.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(raw)
    buf = np.frombuffer(whole.translate(table) if table else whole, np.uint8)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    parts, starts = [], []
    for lo, hi in _cuts(buf):
        h, s = _piece(buf[lo:hi], prefix)
        parts.append(h)
        starts.append(s + lo)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, _U), np.searchsorted(where, begin)


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the words lo to hi (exclusive) hash to (sums[hi] - sums[lo]) * down[lo], wherever they stand."""
    n = len(words) + 1
    sums = np.zeros(n, _U)
    np.cumsum(words * _power(_BASE, n, "up")[:-1], out=sums[1:])
    return sums, _power(pow(_BASE, -1, 1 << 64), n, "down")


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every word, in code points."""
    spans, at, n = [], 0, len(text)
    for w in text.translate(_FLAT).split(" "):
        if w:
            spans.append((at, at + len(w)))
        at += len(w) + 1
    return spans


_FLAT = {c: " " for c in range(0x09, 0x0E)}


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles in order (repeats kept) and their offsets per text.

    A text with fewer words, but some, has its whole sequence as its one shingle.
    """
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    padded = np.concatenate([words, np.zeros(width, _U)])
    first = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    left = np.repeat(np.minimum(n, width), count).astype(_U)
    acc = left.copy()
    for i in range(width):
        w = padded[first + i]
        acc = mix(acc * _U(0x2545F4914F6CDD1D) + np.where(left > _U(i), w, _U(0)) + _U(i))
    return acc, out


def distinct_per_text(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text and their new offsets."""
    parts = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.concatenate(parts) if parts else h[:0], out


def slices(texts: Sequence[str | None], chars: int = PIECE) -> Iterable[slice]:
    """Consecutive index ranges whose texts have about `chars` characters together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
