"""Vectorised numpy kernels over the UTF-8 bytes of an Arrow text column.

Every kernel works on a *slice*: some consecutive rows whose bytes lie side by
side in one buffer, at most about ``SLICE_BYTES`` (a longer text is a slice of
its own), so memory stays bounded whatever the batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1000
HASH_BITS = 54
U64 = np.uint64


def _splitmix_table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POS = _splitmix_table(1 << 12, 7)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS):
    """Yield (first row, row after the last) of slices of bounded size."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; ``at`` starts at 0."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[at[:-1]] = True  # words end at the ends of texts
    first[n] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit multilinear hash of each word."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    raw = buf[place + np.repeat(starts, size)]
    raw = (_LOWER[raw] if lower else raw).astype(U64) + U64(1)
    with np.errstate(over="ignore"):
        far = place >= len(_POS)
        raw *= np.where(far, mix(place.astype(U64)) | U64(1), _POS[np.minimum(place, len(_POS) - 1)]) if far.any() else _POS[place]
        return mix(np.add.reduceat(raw, first) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each run of k words; a text of fewer words has one run of all."""
    count = np.bincount(row, minlength=rows)
    out_h, out_r = [], []
    with np.errstate(over="ignore"):
        if len(words) >= k:
            n = len(words) - k + 1
            whole = row[:n] == row[k - 1 :]
            h = np.zeros(n, U64)
            for j in range(k):
                h += words[j : j + n] * _POS[j]
            out_h.append(mix(h[whole]))
            out_r.append(row[:n][whole])
        for r in np.flatnonzero((count > 0) & (count < k)):
            own = words[row == r]
            out_h.append(mix(np.array([(own * _POS[: len(own)]).sum()], U64) ^ U64(0xA5A5 + len(own))))
            out_r.append(np.array([r]))
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(out_r), np.concatenate(out_h)


def shingle_sets(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text of a slice, as sorted 54-bit hashes.

    Returns the concatenated sets and where each text's begins.
    """
    rows = len(at) - 1
    starts, ends, row = word_spans(buf, at)
    r, h = gram_hashes(word_hashes(buf, starts, ends), row, rows, k)
    low = U64((1 << HASH_BITS) - 1)
    key = np.sort((r.astype(U64) << U64(HASH_BITS)) | (h >> U64(64 - HASH_BITS)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    begin = np.searchsorted(key, np.arange(rows + 1, dtype=U64) << U64(HASH_BITS))
    return key & low, begin


def superminhash(sets: np.ndarray, begin: np.ndarray, m: int, chunk: int = 40_000) -> np.ndarray:
    """SuperMinHash signatures: (rows, m) floats; infinite for an empty set.

    Each element walks a random permutation of the m places; at step j it offers
    j + r to its j-th place. A set is finished once its largest entry is at most
    j + 1, since later steps only offer more. One step mostly does for sets far
    larger than m.
    """
    rows = len(begin) - 1
    sig = np.full((rows, m), np.inf)
    size = np.diff(begin)
    doc = np.repeat(np.arange(rows), size)
    if not len(doc):
        return sig

    def draw(h: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = mix(h + U64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
            y = mix(x ^ U64(0xC2B2AE3D27D4EB4F))
        return (x >> U64(11)) * 2.0**-53, (j + (y >> U64(32)) % U64(m - j)).astype(np.int64)

    r, place = draw(sets, 0)
    np.minimum.at(sig.reshape(-1), doc * m + place, r)
    going = (sig.max(axis=1) > 1) & (size > 0)
    rest = np.flatnonzero(going[doc])
    while len(rest):  # whole texts, some at a time
        end = int(np.searchsorted(doc[rest], doc[rest[min(chunk, len(rest)) - 1]], side="right"))
        mine, rest = rest[:end], rest[end:]
        own, h, first = doc[mine], sets[mine], place[mine]
        perm = np.empty((len(mine), m), dtype=np.uint8 if m <= 256 else np.int32)
        perm[:] = np.arange(m)
        perm[np.arange(len(mine)), first], perm[:, 0] = 0, first
        for j in range(1, m):
            r, k = draw(h, j)
            i = np.arange(len(h))
            got = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
            np.minimum.at(sig.reshape(-1), own * m + got, j + r)
            live = np.unique(own)
            live = live[sig[live].max(axis=1) > j + 1]
            if not len(live):
                break
            keep = np.isin(own, live)
            if not keep.all():
                own, h, perm = own[keep], h[keep], perm[keep]
    return sig


def signature_codes(sig: np.ndarray) -> np.ndarray:
    """16-bit codes of signature entries: equal entries have equal codes."""
    return (mix(sig.view(U64)) >> U64(48)).astype(np.uint16)


def window_hash_pyramid(buf: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` bytes, by doubling."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        level = mix(buf.astype(U64) + U64(0x51_7C_C1_B7))
        have, span = 1, {1: level}
        while have * 2 <= length:
            a, b = level[: len(level) - have], level[have:]
            level = a * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(29))) * U64(0xD6E8FEB86659FD93)
            level ^= level >> U64(32)
            have *= 2
            span[have] = level
        out, at = None, 0
        for size in sorted(span, reverse=True):
            if length - at >= size:
                part = span[size][at : at + n]
                out = mix(part) if out is None else mix(out * U64(0x9FB21C651E98DF25) + part)
                at += size
        return out


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the smallest of each w consecutive values, the leftmost if equal.

    Values compare by their upper 40 bits; len(h) must be under 2**24.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & ~U64(0xFFFFFF)) | np.arange(len(h), dtype=U64)
    if w == 1:
        return np.arange(n)
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & U64(0xFFFFFF)).astype(np.int64)
