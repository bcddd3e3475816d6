"""Words of many texts as numpy arrays.

A column of strings is one UTF-8 byte buffer. A 256-entry table says which
bytes belong to words (every rule here treats all bytes from 0x80 alike, so a
byte table is exact); word starts, ends and 64-bit hashes then come from a few
passes over the buffer. Work goes in slices of about ``SLICE`` bytes; a text
longer than that is cut at a byte between words, so no array follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_ALL = np.arange(256)
#: a-z, 0-9 and all non-ASCII bytes (after A-Z are lower-cased)
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: all but space and \t \n \v \f \r
NONSPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: letters of any script, after lower-casing A-Z
LETTERS = ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POW, _INV = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(texts: pa.Array, keep: np.ndarray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with A-Z lower-cased, piece offsets, text index of each piece):
    consecutive pieces of about ``size`` bytes. Empty texts give empty pieces."""
    raw, off = buffers(texts)
    cuts, doc, at, done = [0], [], 0, 0  # piece ends relative to the slice's first byte
    begin = int(off[0])
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        while hi - begin > size and hi - lo > 0:
            cut = max(lo, begin + size)
            while cut < hi:  # move on to a byte between words
                free = np.flatnonzero(~keep[LOWER[raw[cut:min(hi, cut + 4096)]]])
                if len(free):
                    cut += int(free[0])
                    break
                cut = min(hi, cut + 4096)
            if cut >= hi:
                break
            if hi - lo <= size and len(doc):  # a text that fits is kept in one piece
                yield LOWER[raw[begin:lo]], np.array(cuts), np.array(doc)
                cuts, doc, begin = [0], [], lo
                continue
            cuts.append(cut - begin)
            doc.append(i)
            yield LOWER[raw[begin:cut]], np.array(cuts), np.array(doc)
            cuts, doc, begin, lo = [0], [], cut, cut
        cuts.append(hi - begin)
        doc.append(i)
    if doc:
        yield LOWER[raw[begin:int(off[-1])]], np.array(cuts), np.array(doc)


def _end(raw: np.ndarray, lo: int, hi: int, keep: np.ndarray, every: int, size: int) -> int:
    """Where a piece that begins at ``lo`` ends: at the start of a word before which a multiple of ``every`` words stand."""
    while lo + size < hi:
        inside = keep[LOWER[raw[lo:lo + size]]]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        whole = (len(starts) - 1) // every * every  # words that end in the piece for certain
        if whole > 0:
            return lo + int(starts[whole])
        size *= 2
    return hi


def text_slices(texts: pa.Array, keep: np.ndarray, every: int = 1, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, the same with A-Z lower-cased, piece offsets, text index of each piece).

    A text of at most ``size`` bytes is one piece. A longer one has slices of its own, which end after a
    multiple of ``every`` words, so its pieces depend on that text alone, whatever stands before it."""
    raw, off = buffers(texts)
    begin, cuts, doc = int(off[0]), [0], []
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        if doc and (hi - begin > size):
            yield raw[begin:lo], LOWER[raw[begin:lo]], np.array(cuts), np.array(doc)
            begin, cuts, doc = lo, [0], []
        while hi - lo > size:
            cut = _end(raw, lo, hi, keep, every, size)
            yield raw[lo:cut], LOWER[raw[lo:cut]], np.array([0, cut - lo]), np.array([i])
            begin = lo = cut
        if lo < hi or int(off[i]) == hi:  # what is left of the text, or an empty text
            cuts.append(hi - begin)
            doc.append(i)
        if lo != int(off[i]) and doc:  # the last piece of a long text
            yield raw[begin:hi], LOWER[raw[begin:hi]], np.array(cuts), np.array(doc)
            begin, cuts, doc = hi, [0], []
    if doc:
        end = int(off[-1])
        yield raw[begin:end], LOWER[raw[begin:end]], np.array(cuts), np.array(doc)


def words(data: np.ndarray, cuts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per piece) of the maximal runs of ``keep`` bytes; none spans two pieces."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(cuts) - 1, np.int64)
    inside = keep[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = cuts[cuts < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, cuts))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hash of each word, then of its first k bytes for each k of ``prefixes``."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    back, base = down[starts], total[starts]
    out = [mix((total[ends] - base) * back)]
    for k in prefixes:
        out.append(mix((total[np.minimum(starts + k, ends)] - base) * back + np.uint64(k)))
    return out


def word_hashes(texts: pa.Array, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text)."""
    parts, count = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for data, cuts, doc in slices(texts, keep):
        starts, ends, n = words(data, cuts, keep)
        parts.append(hashes(data, starts, ends)[0])
        np.add.at(count, doc, n)
    return np.concatenate(parts), count


def word_hash(word: str) -> int:
    """The hash that ``hashes`` gives one word (lower-cased by the caller)."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0][0])
