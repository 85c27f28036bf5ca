"""Word and character shingles as 64-bit hashes, and MinHash signatures of them, over whole texts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Code points looked at together, where words allow it.
SLICE = 1 << 17

#: Shingles: (hashes of all texts one after another, where each text's begin; a last entry closes the last text).
Shingles = tuple[np.ndarray, np.ndarray]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that every bit of a rolling hash depends on every input."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@functools.cache
def _units() -> np.ndarray:
    """A well-spread 64-bit number for each code point that a word may hold; 0 for all others."""
    codes = np.arange(1, 0x110001, dtype=np.uint64)
    with np.errstate(over="ignore"):
        units = mixed(mixed(codes * STEP)) | np.uint64(1)
    units[[not (chr(c).isalnum() or c == 95) for c in range(0x110000)]] = 0
    return units


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64, for i under n."""
    inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (STEP, inverse))


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a row of code points begins, and its hash: the sum of unit * STEP ** place, by differences of running sums."""
    begins, hashes, first = [], [], 0
    while first < len(codes):
        last = min(len(codes), first + SLICE)
        units = _units()[codes[first:last]]
        while last < len(codes) and units[-1]:  # a word that goes on: the slice ends before it, or, if it's all one word, behind it
            cut = np.flatnonzero(units == 0)
            if len(cut):
                last = first + cut[-1] + 1
            else:
                last = min(len(codes), last + SLICE)
            units = _units()[codes[first:last]]
        inside = np.concatenate([[False], units != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        b, e = edges[::2], edges[1::2]
        up, down = _powers(max(SLICE, 1 << (len(units) - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)])])
        begins.append(b + first)
        hashes.append(mixed((sums[e] - sums[b]) * down[b]))
        first = last
    return (np.concatenate(begins), np.concatenate(hashes)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _windows(units: np.ndarray, counts: np.ndarray, size: int) -> Shingles:
    """Hashes of each text's windows of size units; a shorter text that isn't empty is one window."""
    ends = np.cumsum(counts)
    begins, n = ends - counts, len(units)
    up, down = _powers(1 << max(1, n).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[:n])])
    rolled, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= size:
        rolled[: n - size + 1] = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        whole[: n - size + 1] = True
    full = ends[counts >= size]
    for i in range(1, size):  # windows that would run into the next text
        whole[full - i] = False
    few = np.flatnonzero((counts > 0) & (counts < size))
    for i in range(size - 1):
        at = few[counts[few] > i]
        whole[begins[at] + i] = i == 0
    rolled[begins[few]] = (sums[ends[few]] - sums[begins[few]]) * down[begins[few]] + counts[few].astype(np.uint64)
    return mixed(rolled[whole]), np.concatenate([[0], np.cumsum(np.where(counts < size, counts > 0, counts - size + 1))])


def word_shingles(texts: list[str | None], size: int = 5) -> Shingles:
    """Windows of size lower-cased words (runs of letters, digits and underscores)."""
    own = [(text or "").lower() for text in texts]
    with np.errstate(over="ignore"):
        begins, hashes = _words(np.frombuffer("\n".join(own).encode("utf-32-le", "surrogatepass"), np.uint32))
        ends = np.cumsum([len(t) + 1 for t in own])  # behind each text's line end
        counts = np.diff(np.searchsorted(begins, ends), prepend=0)
        return _windows(hashes, counts, size)


def char_shingles(texts: list[str | None], size: int = 8) -> Shingles:
    """Windows of size characters."""
    counts = np.array([len(t or "") for t in texts], np.int64)
    units = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _windows(mixed(units + STEP), counts, size)


def signatures(shingles: Shingles, hashes: int, seed: int = 7) -> np.ndarray:
    """For each text that has shingles, in order, the low 16 bits of its MinHash under so many hash functions."""
    values, at = shingles
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), hashes), np.uint16)
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**32, hashes, np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, hashes, np.uint32)
    low, begin = (values >> np.uint64(32)).astype(np.uint32), at[full]
    first = 0
    while first < len(full):  # pieces that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + (1 << 15))))
        piece = low[begin[first] : begin[last] if last < len(full) else len(low)]
        cuts, hashed = begin[first:last] - begin[first], np.empty(len(piece), np.uint32)
        for i in range(hashes):
            np.multiply(piece, odd[i], out=hashed)
            hashed += add[i]
            out[first:last, i] = np.minimum.reduceat(hashed, cuts)
        first = last
    return out


def pieces(texts: list[str | None], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters each, so that memory doesn't follow the batch."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def signer(shingle: Callable[[list[str | None]], Shingles], hashes: int) -> Callable:
    """mapInArrow function from (node long, text string) to (node, sig binary), a node once in a partition; texts without shingles go."""
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1)
            fresh = []
            for i, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            texts = texts.take(pa.array(fresh, pa.int64())).to_pylist()
            for a, b in pieces(texts):
                own = shingle(texts[a:b])
                full = np.flatnonzero(np.diff(own[1]))
                sigs = signatures(own, hashes)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[fresh[a + i]] for i in full], pa.int64()), pa.array([s.tobytes() for s in sigs], pa.binary())], ["node", "sig"])

    return sign
