"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes other than space and U+0009..U+000D. These
separators are single bytes in UTF-8, so the work is done on the raw buffer of
an Arrow string column, without a Python object for each word.

A word's hash is a sum of its bytes, each times a 64-bit factor of its place in
the word, mixed with the length. The factors look random and don't repeat, so
two words that differ by structure (periods, swaps) meet no more often than any
others, which a power of one base modulo 2**64 can't promise.

Edge cases: a null text has no words, like one of separators only; a text of
any length is cut at separators into chunks, and a word longer than a chunk is
hashed in pieces with the same result; an empty column gives nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes handled at once. Longer texts are cut at separators, and words longer than this in pieces.
CHUNK = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows that an operator looks at together: batches of long texts would hold much at once.
SLICE = 1000


def slices(batches, rows: int = SLICE):
    """Batches in slices of a few rows; at the end, what Arrow holds in reserve goes back."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def _factors_at(first: int, n: int) -> np.ndarray:
    """Odd factors of the places first, first + 1, ... in a word."""
    return mix64(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return _factors_at(0, CHUNK)


def _sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of ``raw``; spans are in order, not empty, and of CHUNK bytes at most."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    data = raw[place + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    return np.add.reduceat(data * _factors()[place], begin)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' byte spans and the rows' word offsets."""
    separator = _SEPARATOR[raw]
    n = len(raw)
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = separator[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = separator[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~separator)
    ends = np.flatnonzero(after & ~separator) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_chunk(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte spans and the rows' word offsets, for at most CHUNK bytes."""
    starts, ends, where = _spans(raw, offsets)
    return _sums(raw, starts, ends), starts, ends, where


def _long_text(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like _hash_chunk for one row of any length."""
    values, starts, ends = [], [], []
    at, n = 0, len(raw)
    while at < n:
        stop = min(at + CHUNK, n)
        if stop < n and not _SEPARATOR[raw[stop - 1]]:
            cuts = np.flatnonzero(_SEPARATOR[raw[at:stop]])
            if len(cuts):
                stop = at + int(cuts[-1]) + 1
            else:
                stop = _giant_word(raw, at, values, starts, ends)
                at = stop
                continue
        value, start, end, _ = _hash_chunk(raw[at:stop], np.array([0, stop - at]))
        values.append(value)
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return cat(values, np.uint64), cat(starts, np.int64), cat(ends, np.int64)


def _giant_word(raw: np.ndarray, at: int, values: list, starts: list, ends: list) -> int:
    """Hash the word at ``at``, which has no separator within CHUNK bytes; where it ends."""
    total, here = np.uint64(0), at
    while here < len(raw):
        piece = raw[here : here + CHUNK]
        cut = np.flatnonzero(_SEPARATOR[piece])
        size = int(cut[0]) if len(cut) else len(piece)
        total += np.sum((piece[:size].astype(np.uint64) + np.uint64(1)) * _factors_at(here - at, size), dtype=np.uint64)
        here += size
        if len(cut):
            break
    values.append(np.array([total], dtype=np.uint64))
    starts.append(np.array([at], dtype=np.int64))
    ends.append(np.array([here], dtype=np.int64))
    return here


class Words:
    """The words of consecutive rows.

    first, last: the rows; hashes: 64 bits for each word; offsets: where each
    row's words begin; starts, ends: byte spans in ``raw``; bounds: the rows'
    bytes there.
    """

    __slots__ = ("bounds", "ends", "first", "hashes", "last", "offsets", "raw", "starts")

    def __init__(self, first, last, hashes, offsets, starts, ends, raw, bounds):
        self.first, self.last, self.hashes, self.offsets = first, last, hashes, offsets
        self.starts, self.ends, self.raw, self.bounds = starts, ends, raw, bounds


def words(column: pa.Array, lower: bool = False, hashed: bool = True):
    """Words of a text column, in groups of rows of about CHUNK bytes.

    hashed: without it there are no hashes, and a text longer than CHUNK has no words.
    """
    raw, offsets = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        part = raw[offsets[row] : offsets[stop]]
        if lower:
            part = _LOWER[part]
        own = offsets[row : stop + 1] - offsets[row]
        if len(part) == 0 or (len(part) > CHUNK and not hashed):
            empty = np.zeros(0, dtype=np.int64)
            yield Words(row, stop, empty.astype(np.uint64), np.zeros(stop - row + 1, dtype=np.int64), empty, empty, part, own)
        elif not hashed:
            starts, ends, where = _spans(part, own)
            yield Words(row, stop, np.zeros(0, dtype=np.uint64), where, starts, ends, part, own)
        else:
            if len(part) <= CHUNK:
                value, starts, ends, where = _hash_chunk(part, own)
            else:
                value, starts, ends = _long_text(part)
                where = np.array([0, len(value)])
            yield Words(row, stop, mix64(value ^ mix64((ends - starts).astype(np.uint64))), where, starts, ends, part, own)
        row = stop


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words; row borders are not looked at."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for k, factor in enumerate(_factors_at(0, n)):
        total += hashes[k : k + m] * factor
    return mix64(total + np.uint64(n))


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_ALNUM
_MARK[ord("'")] = False


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Whether an ASCII mark other than an apostrophe follows an ASCII letter or digit: no pre-token goes on over that place."""
    cut = np.zeros(len(raw), dtype=bool)
    np.logical_and(_ALNUM[raw[:-1]], _MARK[raw[1:]], out=cut[1:])
    return cut


def spaced_units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, byte spans and row offsets of words with the separators before them, cut before marks, and of rows' last separators."""
    n = len(w.raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[:n] = _cuts(w.raw)
    edge[w.ends] = True
    edge[w.bounds] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    return span_keys(w.raw, starts, ends), starts, ends, np.searchsorted(starts, w.bounds)


def bare_units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, byte spans and row offsets of words, cut before marks."""
    first, last = np.zeros(len(w.raw) + 1, dtype=bool), np.zeros(len(w.raw) + 1, dtype=bool)
    first[:-1] = last[:-1] = _cuts(w.raw)
    first[w.starts] = True
    last[w.ends] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return span_keys(w.raw, starts, ends), starts, ends, np.searchsorted(starts, w.bounds)


def folded(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but for those before a byte beyond ASCII, which may be an accent that only one case takes."""
    out = _LOWER[raw]
    before = np.flatnonzero(raw[1:] >= 0x80)
    out[before] = raw[before]
    return out


#: Masks of the lowest 0 to 8 bytes.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on, as numbers; zeros follow its end."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_lanes(raw8: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(k, spans, eight bytes): the k-th eight bytes of those spans that have them, zeros after their end. ``raw8``: of eights()."""
    yield 0, slice(None), raw8[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
    k, more = 1, np.flatnonzero(sizes > 8)
    while len(more):
        yield k, more, raw8[starts[more] + 8 * k] & _LOW_BYTES[np.minimum(sizes[more] - 8 * k, 8)]
        k += 1
        more = more[sizes[more] > 8 * k]


def span_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``raw``, from eight bytes at a time."""
    sizes = ends - starts
    total = sizes.astype(np.uint64)
    for k, some, lane in span_lanes(eights(raw), starts, sizes):
        total[some] += mix64(lane + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return mix64(total)
