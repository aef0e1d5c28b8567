"""Suffix-array dedup by a run-length index: bytes covered by a 50-byte string that starts in an earlier document.

Every stretch of LENGTH bytes is judged on the input: if the same bytes start in a document of smaller doc_id,
the stretch is covered, and the union of covered stretches goes. The corpus is never sorted as a whole:

1. Anchors. Of the 26 substrings of 25 bytes in a stretch, the one with the least hash is its anchor (a minimizer), so
   equal stretches have equal anchors at equal places. An anchor's context is the text from 25
   bytes before it to 25 after: all stretches it can stand for. One scan packs (anchor, hash of context, hashes of its sides, row,
   place) by ranges of the anchor's hash. Equal contexts of one slice are combined before the shuffle: only
   the earliest document's go on, as the others are covered whole.
2. Ranges. Anchors of one document only are dropped, which is most of a corpus. Later holders of an equal context are
   covered whole. A stretch around an anchor holds at least 13 bytes (HALF) before it or 13 after it, so different contexts share
   none unless they agree in one of these sides. What is left is one holder for each different context that agrees so with another.
3. Run-length index. Those contexts, fetched from the texts, are indexed by range: suffix order by prefix doubling, the
   Burrows-Wheeler transform kept as runs with sampled suffix positions at run ends, and for each class of rows that
   agree in LENGTH bytes the earliest document. Every context is then streamed backwards through the
   run-length LF mapping; the row it stands at tells whether its match is LENGTH long and
   in an earlier document. The samples check the walk.
4. Marks are joined to the texts, merged, and cut out.

Bytes decide, not hashes, wherever contexts of an anchor differ; equal contexts are told by 48 bits beside the anchor's own.

Cases: a null text is empty; a null doc_id is later than all others and never covers anything; rows of one doc_id
never cover each other; texts under LENGTH bytes stay whole; repeated rows give equal results; an
empty table gives no rows; extra columns are kept by ``remove`` and ignored by ``digest``. Offsets are 32 bits: texts under 4 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
GRAM = 25
SIDE = LENGTH - GRAM
HALF = (SIDE + 1) // 2  # a stretch has so many bytes on one side of its anchor at least
LAST = np.iinfo(np.int64).max  # the place of a null doc_id
SCAN_BYTES = 1 << 19
PART_BYTES = 16 << 20  # of text whose anchors one range holds, about
FANOUT = 1 << 12  # ranges that one step deals anchors to; with more, a second step deals them again
FLUSH = 1 << 19  # anchors, or marks, that a worker holds unpacked
PIECE = 1 << 18
INDEX_SYMBOLS = 1 << 19
RANGES = 512  # of contexts, each with one index; beyond, a range has up to INDEXES of them, as blobs grow with ranges times tasks
INDEXES = 64
_U = np.uint64


def _slide(a: np.ndarray, fold, width: int) -> np.ndarray:
    out, step, n = a, 1, len(a) - width + 1
    while step * 2 <= width:
        out = fold(out[:-step], out[step:])
        step *= 2
    return fold(out[:n], out[width - step : width - step + n])


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a slice's texts and their hashes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = lambda k: _U(pow(common._P, k, 1 << 64))
    with np.errstate(over="ignore"):
        one = common._BYTE[data]
        h = one
        for k in (1, 2, 4):
            h = h[:-k] * power(k) + h[k:]
        eight = h
        h = h[:-8] * power(8) + h[8:]
        m = n - GRAM + 1
        h = (h[:m] * power(8) + eight[16 : 16 + m]) * power(1) + one[24 : 24 + m]
        h = common.mix(h) | _U(1)
    least = _slide(h, np.minimum, SIDE + 1)
    start = np.arange(len(least))
    end = np.repeat(offs[1:], np.diff(offs))[: len(least)]
    least[start + LENGTH > end] = 0
    pad = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum, SIDE + 1) == h)
    return at, h[at]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def _hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << _U(32))


def _split48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & _U(0xFFFFFFFF)).astype(np.uint32), (x >> _U(32)).astype(np.uint16)


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range that a 48-bit hash falls in, by its lower bits: an anchor is the least hash of its window, so the upper ones are mostly 0."""
    return ((h & _U(0xFFFFFFFF)) * _U(parts) >> _U(32)).astype(np.int64)


_BLOB = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("rows", pa.int64()), ("table", pa.binary()), ("blob", pa.binary())])
_BLOB_SQL = "part int, n long, rows long, table binary, blob binary"
_MARK = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("cover", pa.binary()), ("first", pa.binary())])
_MARK_SQL = "key long, tag long, cover binary, first binary"
WHOLE, FIRST, COVER = 0, 1, 2  # an anchor whose context is covered; one that needs the index; a place whose next LENGTH bytes are covered


def _blobs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 64]], f.type) for k, f in enumerate(_BLOB)], schema=_BLOB)


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(part, n, rows, table, blob) of a batch of blobs."""
    return zip(*(batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in _BLOB), strict=True)


def _kinds(n: int) -> list[tuple[str, int]]:
    return [("<u4", n), ("<u2", n), ("<u4", n), ("<u2", n), ("<u4", n), ("<u4", n), ("<i4", n)]


def _deal(parts: int, got: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Anchors (keys and tags of rows, row, place, hash, hash of context, hashes of sides) packed by ranges of the hash.

    Of equal contexts only the earliest document's go to their range; part -1 carries the others, which are covered whole.
    """
    base = np.cumsum([0, *(len(g[0]) for g in got[:-1])])
    keys, tags = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    row = np.concatenate([g[2] + b for g, b in zip(got, base, strict=True)])
    place, h, c, s = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5, 6))
    got.clear()
    with np.errstate(over="ignore"):
        whole = common.mix(h + common.mix(c))
    order = np.lexsort((keys[row], whole))
    w, k = whole[order], keys[row][order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    keep = np.ones(len(w), bool)
    if len(w):
        keep[order[k > k[np.flatnonzero(new)][np.cumsum(new) - 1]]] = False
    del whole, order, w, k, new
    rows = []
    some = np.flatnonzero(~keep)
    if len(some):
        used, local = np.unique(row[some], return_inverse=True)
        rows.append((-1, len(some), len(used), _pack(keys[used], tags[used]), _pack(local.astype(np.uint32), place[some].astype(np.uint32))))
    part = _range_of(h, parts)
    live = np.flatnonzero(keep)
    live = live[np.argsort(part[live], kind="stable")]
    edge = np.flatnonzero(np.diff(part[live], prepend=-1, append=parts))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = live[a:b]
        used, local = np.unique(row[own], return_inverse=True)
        rows.append((int(part[own[0]]), b - a, len(used), _pack(keys[used], tags[used]), _pack(*_split48(h[own]), *_split48(c[own]), s[own], local.astype(np.uint32), np.diff(place[own], prepend=0).astype(np.int32))))
    del keys, tags, row, place, h, c, s, part, live, keep
    common.trim()
    yield from _blobs(rows)


def _context(data: np.ndarray, at: np.ndarray, start: np.ndarray | int, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """48 bits for each context, and 16 for each of its sides: the anchor with HALF bytes before it, and with HALF after it.

    Where a text's edge cuts a context, the place of the anchor in it matters too; a side that an edge cuts is 0, which equals none.
    """
    before, after = at - HALF >= start, at + GRAM + HALF <= end
    low = np.concatenate([np.maximum(at - SIDE, start), at - HALF * before, at])
    high = np.concatenate([np.minimum(at + LENGTH, end), at + GRAM, at + GRAM + HALF * after])
    whole, left, right = np.split(common.hash_spans(data, low, high), 3)
    with np.errstate(over="ignore"):
        c = common.mix(whole + np.minimum(at - start, SIDE).astype(np.uint64)) >> _U(16)
    left, right = (np.where(there, np.maximum(x & _U(0xFFFF), _U(1)), _U(0)) for x, there in ((left, before), (right, after)))
    return c, (left | right << _U(16)).astype(np.uint32)


def _anchored(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, hash, hash of context, hashes of sides) of a slice's anchors. A long text comes in windows that overlap by a stretch."""
    n = len(data)
    if len(offs) > 2 or n <= 2 * SCAN_BYTES:
        at, h = anchors(data, offs)
        row = np.searchsorted(offs, at, side="right") - 1
        yield row, at - offs[row], h >> _U(16), *_context(data, at, offs[row], offs[row + 1])
        return
    last = np.zeros(0, np.int64)
    for a in range(0, n, SCAN_BYTES):
        b = min(n, a + SCAN_BYTES + LENGTH - 1)
        at, h = anchors(data[a:b], np.array([0, b - a]))
        at = at + a
        new = ~np.isin(at, last)
        last, at, h = at, at[new], h[new]
        low = max(0, a - SIDE)
        yield np.zeros(len(at), np.int64), at, h >> _U(16), *_context(data[low : b + SIDE], at - low, -low, n - low)
        if b == n:
            return


def _scan(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            keys, tags = (batch.column(k).to_numpy() for k in (0, 1))
            for i, j, data, offs in common.slices(batch, "text", SCAN_BYTES):
                for found in _anchored(data, offs):
                    got.append((keys[i:j], tags[i:j], *found))
                    size += len(found[0])
                    if size >= FLUSH:
                        yield from _deal(parts, got)
                        size = 0
        if got:
            yield from _deal(parts, got)

    return run


def _deal_again(parts: int):
    """Blobs of a few wide ranges to blobs of the narrow ones in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            done = []
            for part, n, rows, t, blob in _each(batch):
                if part < 0:
                    done.append((part, n, rows, t, blob))
                    continue
                lo, hi, c0, c1, s, local, place = _unpack(blob, _kinds(n))
                got.append((*_unpack(t, [("<i8", rows), ("<i8", rows)]), local.astype(np.int64), np.cumsum(place, dtype=np.int64), _hashes(lo, hi), _hashes(c0, c1), s))
                size += n
            yield from _blobs(done)
            if size >= FLUSH:
                yield from _deal(parts, got)
                size = 0
        if got:
            yield from _deal(parts, got)

    return run


class _Marks:
    """Marks of one task, packed by parts of documents, so their number of rows follows the parts and not the marks."""

    def __init__(self, parts: int) -> None:
        self.parts, self.got, self.size = parts, [], 0

    def add(self, key: np.ndarray, tag: np.ndarray, place: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        if len(place):
            self.got.append((key, tag, place.astype(np.uint32), np.full(len(place), kind, np.uint8)))
            self.size += len(place)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, tag, place, kind = (np.concatenate(x) for x in zip(*self.got, strict=True))
        self.got, self.size = [], 0
        part = ((common.mix(tag.view(np.uint64)) >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)
        order = np.lexsort((key, tag, part))
        key, tag, place, kind, part = (x[order] for x in (key, tag, place, kind, part))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=self.parts))
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            one = a + np.flatnonzero(new[a:b])
            out.append((int(part[a]), b - a, len(one), _pack(key[one], tag[one]), _pack((np.cumsum(new[a:b]) - 1).astype(np.uint32), place[a:b], kind[a:b])))
        yield from _blobs(out)


def _gather(first: bool):
    """One row for each document of a part: its open anchors, or its covered places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for _, n, rows, t, blob in _each(batch):
                local, place, kind = _unpack(blob, [("<u4", n), ("<u4", n), ("u1", n)])
                some = np.flatnonzero((kind == FIRST) == first)
                if len(some):
                    keys, tags = _unpack(t, [("<i8", rows), ("<i8", rows)])
                    got.append((keys[local[some]], tags[local[some]], place[some], kind[some] != WHOLE))
        if not got:
            return
        key, tag, place, other = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((place, other, tag, key))
        key, tag, place, other = key[order], tag[order], place[order], other[order]
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        edge = np.flatnonzero(new)
        middle = edge[1:] - np.add.reduceat(other.astype(np.int64), edge[:-1])
        for i in range(0, len(middle), 256):
            a, m, b = edge[i : i + 256][: len(middle) - i], middle[i : i + 256], edge[i + 1 : i + 257]
            covers, firsts = ([place[x:y].tobytes() for x, y in zip(p.tolist(), q.tolist(), strict=True)] for p, q in ((a, m), (m, b)))
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(tag[a]), pa.array(covers, pa.binary()), pa.array(firsts, pa.binary())], schema=_MARK)

    return run


def _agree(group: np.ndarray, side: np.ndarray, key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which contexts have a side that another context and another key of the group have too."""
    out = np.zeros(len(side), bool)
    order = np.flatnonzero(side)
    if not len(order):
        return out
    order = order[np.lexsort((side[order], group[order]))]
    new = np.ones(len(order), bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (side[order[1:]] != side[order[:-1]])
    at = np.flatnonzero(new)
    several = [np.minimum.reduceat(x, at) < np.maximum.reduceat(x, at) for x in (key[order], context[order])]
    out[order] = (several[0] & several[1])[np.cumsum(new) - 1]
    return out


def _resolve(parts: int):
    """One range of anchors: what is covered whole, and the holders of contexts that need the index.

    The range's blobs are unpacked once, into narrow columns; anchors are judged by pieces of about PIECE of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held, total = _Marks(parts), [], 0
        for batch in batches:
            for part, n, rows, t, blob in _each(batch):
                if part < 0:  # covered in their own slice
                    keys, tags = _unpack(t, [("<i8", rows), ("<i8", rows)])
                    local, place = _unpack(blob, [("<u4", n), ("<u4", n)])
                    yield from marks.add(keys[local], tags[local], place, WHOLE)
                else:
                    held.append((n, rows, t, blob))
                    total += n
        if held:
            columns, docs = [], []
            base = 0
            held.reverse()
            while held:
                n, rows, t, blob = held.pop()
                lo, hi, c0, c1, s, local, place = _unpack(blob, _kinds(n))
                columns.append((lo, hi, c0, c1, s, local + np.uint32(base), np.cumsum(place, dtype=np.int64).astype(np.uint32)))
                docs.append(_unpack(t, [("<i8", rows), ("<i8", rows)]))
                base += rows
            columns = [np.concatenate(x) for x in zip(*columns, strict=True)]
            keys, tags = (np.concatenate(x) for x in zip(*docs, strict=True))
            del docs
        pieces = -(-total // PIECE)
        for piece in range(pieces):
            some = np.flatnonzero((columns[0] & 0xFFFF) * np.uint32(pieces) >> 16 == piece)
            if not len(some):
                continue
            lo, hi, c0, c1, side, own, place = (x[some] for x in columns)
            key, tag, h, c = keys[own], tags[own], _hashes(lo, hi), _hashes(c0, c1)
            del some, lo, hi, c0, c1, own
            order = np.lexsort((key, c, h))
            hs = h[order]
            # most anchors occur once
            twin = np.zeros(len(hs), bool)
            twin[1:] = hs[1:] == hs[:-1]
            again = twin.copy()
            again[:-1] |= twin[1:]
            order = order[again]
            if not len(order):
                continue
            hs, cs, k = hs[again], c[order], key[order]
            new_h = ~twin[again]
            new_c = new_h.copy()
            new_c[1:] |= cs[1:] != cs[:-1]
            at_h, at_c = np.flatnonzero(new_h), np.flatnonzero(new_c)
            in_h = np.cumsum(new_h) - 1
            least, most = np.minimum.reduceat(k, at_h), np.maximum.reduceat(k, at_h)
            late = k > k[at_c][np.cumsum(new_c) - 1]
            several = np.add.reduceat(new_c.astype(np.int64), at_h) > 1
            first = np.flatnonzero(~late & (several & (least < most))[in_h])
            in_c, side = np.cumsum(new_c) - 1, side[order]
            first = first[_agree(in_h[first], side[first] & 0xFFFF, k[first], in_c[first]) | _agree(in_h[first], side[first] >> 16, k[first], in_c[first])]
            for pick, kind in ((order[late], WHOLE), (order[first], FIRST)):
                yield from marks.add(key[pick], tag[pick], place[pick], kind)
            del key, tag, h, c, side, place, order, hs, cs, k, twin, again, new_h, new_c, at_h, at_c, in_h, in_c, late, first
            common.trim()
        yield from marks.flush()

    return run


def _gram_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits of the GRAM bytes at each place."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            h = h * _U(common._P) + common._BYTE[data[at + k]]
        return common.mix(h) >> _U(16)


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of stretches (start, size), one after another."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _contexts(parts: int):
    """Texts and places of their open anchors to contexts, packed by the anchor's range."""

    def packed(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, key, tag, at, size, left, body = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(part, kind="stable")
        start = np.cumsum(size) - size
        part, key, tag, at, size, left, start = (x[order] for x in (part, key, tag, at, size, left, start))
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        rows = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            meta = _pack(key[a:b], tag[a:b], at[a:b].astype(np.uint32), size[a:b].astype(np.uint8), left[a:b].astype(np.uint8))
            rows.append((int(part[a]), b - a, int(size[a:b].sum()), meta, _pack(body[_spread(start[a:b], size[a:b])])))
        yield from _blobs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, total = [], 0
        for batch in batches:
            for key, tag, text, firsts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                at = np.frombuffer(firsts, "<u4").astype(np.int64)
                low = np.maximum(at - SIDE, 0)
                size = np.minimum(at + LENGTH, len(data)) - low
                got.append((_range_of(_gram_hash(data, at), parts), np.full(len(at), key), np.full(len(at), tag), low, size, at - low, data[_spread(low, size)]))
                total += len(at)
            if total >= FLUSH // 4:
                yield from packed(got)
                total = 0
        if got:
            yield from packed(got)

    return run


class RunLengthIndex:
    """Strings of symbols in a run-compressed Burrows-Wheeler transform, with samples at run ends.

    Rows are suffixes in order. Kept are, for each run of equal preceding symbols, where it starts, where LF sends it and
    which run that is in, the suffix position at its last row, and for each class of rows that agree in ``depth``
    symbols the least owner of a suffix that long.
    """

    def __init__(self, body: np.ndarray, sizes: np.ndarray, owner: np.ndarray, depth: int) -> None:
        """body: the strings' symbols one after another, 0 and up."""
        count = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        text = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = body + count
        text[ends] = np.arange(count)  # each string ends in a symbol of its own, so suffixes differ soon
        order, rank_at = self._suffixes(text, depth)
        middle, step = rank_at
        # classes of rows that agree in ``depth`` symbols
        reach = np.minimum(order + (depth - step), n - 1)
        same = (middle[order[1:]] == middle[order[:-1]]) & (middle[reach[1:]] == middle[reach[:-1]])
        self.class_start = np.append(0, np.flatnonzero(~same) + 1)
        of = np.repeat(np.arange(count), sizes + 1)
        enough = np.arange(n) + depth <= ends[of]
        self.class_owner = np.minimum.reduceat(np.where(enough, owner[of], LAST)[order], self.class_start)
        # runs of the transform; LF keeps equal symbols in order
        before = text[order - 1]
        self.run_start = np.flatnonzero(np.diff(before, prepend=-1))
        run_size = np.diff(np.append(self.run_start, n))
        by_symbol = np.argsort(before[self.run_start], kind="stable")
        self.run_to = np.zeros(len(run_size), np.int64)
        self.run_to[by_symbol] = np.cumsum(run_size[by_symbol]) - run_size[by_symbol]
        self.run_next = np.searchsorted(self.run_start, self.run_to, side="right") - 1
        self.run_end = self.run_start + run_size
        self.sample = order[self.run_end - 1]
        self.row_of_end = np.zeros(count, np.int64)
        self.row_of_end[of[order[:count]]] = np.arange(count)  # rows of the ends come first
        self.sizes, self.ends, self.depth = sizes, ends, depth

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, int]]:
        """The suffix array by prefix doubling, and the ranks by the longest prefix not over ``depth``."""
        n = len(text)
        bits = max(1, int(text.max()).bit_length())
        step = min(depth, 63 // bits)
        key = np.zeros(n, np.uint64)
        for k in range(step):
            key = key << _U(bits)
            key[: n - k] |= text[k:].astype(np.uint64)
        kept = None
        while True:
            order = np.argsort(key)
            new = np.zeros(n, np.int64)
            new[1:] = np.diff(key[order]) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if step <= depth:
                kept = rank, step
            if int(rank[order[-1]]) == n - 1:
                break
            key = rank.astype(np.uint64) << _U(32)
            key[: max(0, n - step)] |= (rank[step:] + 1).astype(np.uint64)
            step *= 2
        return order, kept

    def stream(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of each stretch of ``depth`` symbols that occurs in a string of a smaller owner."""
        row, live = self.row_of_end.copy(), np.arange(len(self.sizes))
        run = np.searchsorted(self.run_start, row, side="right") - 1
        strings, offsets, k = [], [], 0
        while len(live):
            k += 1
            keep = self.sizes[live] >= k
            live, row, run = live[keep], row[keep], run[keep]
            sampled = row == self.run_end[run] - 1
            if not np.array_equal(self.sample[run[sampled]], self.ends[live[sampled]] - k + 1):
                raise RuntimeError("the walk left its string")
            row, run = self.run_to[run] + row - self.run_start[run], self.run_next[run]
            late = np.flatnonzero(row >= self.run_end[run])
            while len(late):  # the next run that holds the row is a few steps on
                run[late] += 1
                late = late[row[late] >= self.run_end[run[late]]]
            if k >= self.depth:
                least = self.class_owner[np.searchsorted(self.class_start, row, side="right") - 1]
                hit = least < owner[live]
                strings.append(live[hit])
                offsets.append(self.sizes[live[hit]] - k)
        return np.concatenate(strings or [live]), np.concatenate(offsets or [live])


def _match(parts: int):
    """Contexts of one range to the places whose next LENGTH bytes an earlier document holds.

    The anchor of a context is one symbol, so a stretch of LENGTH bytes around it is SIDE + 1 symbols.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for _, n, total, meta, blob in _each(batch):
                key, tag, at, size, left = _unpack(meta, [("<i8", n), ("<i8", n), ("<u4", n), ("u1", n), ("u1", n)])
                got.append((key, tag, at, size.astype(np.int64), left.astype(np.int64), *_unpack(blob, [("u1", total)])))
        if not got:
            return
        key, tag, at, size, left, data = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        start = np.cumsum(size) - size
        words = np.zeros((len(size), 32), np.uint8)
        words[:, :GRAM] = data[(start + left)[:, None] + np.arange(GRAM)]
        names = words.view(np.uint64)
        order = np.lexsort(names.T)
        new = np.ones(len(order), bool)
        new[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1)
        del words, names
        # an index holds whole anchors, so it may be larger where one of them has many contexts
        symbols = size[order] - GRAM + 2
        before = np.cumsum(symbols) - symbols
        first = np.flatnonzero(new)
        index = (before[first] // INDEX_SYMBOLS)[np.cumsum(new) - 1]
        marks = _Marks(parts)
        edge = np.flatnonzero(np.diff(index, prepend=-1, append=index[-1] + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[a:b]
            string, offset = _matches(data[_spread(start[own], size[own])], size[own], left[own], np.cumsum(new[a:b]) - 1, key[own])
            own = own[string]
            yield from marks.add(key[own], tag[own], at[own].astype(np.int64) + offset, COVER)
            common.trim()
        yield from marks.flush()

    return run


def _matches(data: np.ndarray, size: np.ndarray, left: np.ndarray, anchor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the stretches that a context of a smaller key holds too; ``anchor`` numbers the contexts' anchors."""
    at = np.cumsum(size) - size + left
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, at + 1, 1)
    np.add.at(inside, at + GRAM, -1)
    body = data.astype(np.int64)
    body[at] = anchor + 256
    return RunLengthIndex(body[np.cumsum(inside[:-1], dtype=np.int8) == 0], size - GRAM + 1, key, SIDE + 1).stream(key)


def _keyed() -> tuple[Column, Column, Column]:
    """A row's key (its doc_id, or the last place), the tag of its text, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))), F.xxhash64(text), text


def marks(docs: DataFrame) -> DataFrame:
    """(key, tag, whole, cover): for rows with repeats, places whose full context, or whose next LENGTH bytes, are covered."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(*[c.alias(n) for c, n in zip(_keyed(), ("key", "tag", "text"), strict=True)])
    # ranges follow the bytes to scan, so that one range's blobs fit a worker
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    parts = wide
    if wide > FANOUT:
        wide, parts = FANOUT, FANOUT * -(-wide // FANOUT)
    blobs = texts.mapInArrow(_scan(wide), _BLOB_SQL)
    spread = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("blob"), F.lit(wide))).otherwise(F.col("part")).alias("range")
    if parts > wide:
        blobs = blobs.repartition(spread).sortWithinPartitions("part").mapInArrow(_deal_again(parts), _BLOB_SQL)
    found = common.materialize(blobs.groupBy(spread).applyInArrow(_resolve(parts), _BLOB_SQL), "marks")
    opened = common.materialize(found.groupBy("part").applyInArrow(_gather(True), _MARK_SQL).where(F.length("first") > 0).select("key", "tag", "first"), "opened")
    # indexes follow the number of contexts, so that one holds about INDEX_SYMBOLS
    symbols = (opened.agg(F.sum(F.length("first"))).first()[0] or 0) // 4 * (2 * SIDE + 2)
    indexes = max(1, -(-symbols // INDEX_SYMBOLS))
    ranges = max(min(indexes, RANGES), -(-indexes // INDEXES))
    contexts = texts.join(opened, ["key", "tag"]).select("key", "tag", "text", "first").mapInArrow(_contexts(ranges), _BLOB_SQL)
    matched = common.materialize(contexts.groupBy("part").applyInArrow(_match(parts), _BLOB_SQL), "marks")
    covered = found.unionByName(matched).groupBy("part").applyInArrow(_gather(False), _MARK_SQL)
    return covered.select("key", "tag", F.col("cover").alias("whole"), F.col("first").alias("cover")).where((F.length("whole") > 0) | (F.length("cover") > 0))


def spans(size: int, whole: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Maximal covered runs (start, end) of a text of so many bytes."""
    low = np.concatenate([np.maximum(whole - SIDE, 0), cover])
    high = np.concatenate([np.minimum(whole + LENGTH, size), cover + LENGTH])
    if not len(low):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    edge = np.flatnonzero(new)
    return np.stack([low[edge], high[np.append(edge[1:], len(low)) - 1]], axis=1)


def _cut(text: str, whole: bytes | None, cover: bytes | None) -> tuple[bytes, np.ndarray]:
    raw = text.encode()
    places = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in (whole, cover)]
    gone = spans(len(raw), *places)
    kept, at = [], 0
    for a, b in gone.tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), gone


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, *rest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            kept, gone = _cut(*rest)
            removed = int((gone[:, 1] - gone[:, 0]).sum())
            rows.append((doc_id, len(kept) + removed, removed, len(gone), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _marked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the names of three more columns: whole text, and its two kinds of covered places."""
    key, tag, text, k, t, whole, cover = names = common.unused(docs, "key", "tag", "whole_text", "k", "t", "whole", "cover")
    found = marks(docs).withColumnsRenamed({"key": k, "tag": t, "whole": whole, "cover": cover})
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_keyed(), names, strict=False)])
    return rows.join(found, (F.col(key) == F.col(k)) & (F.col(tag) == F.col(t)), "left"), [text, whole, cover]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    rows, names = _marked(docs.select("doc_id", "text"))
    return rows.select(F.col("doc_id").cast("long"), *names).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """docs with covered bytes cut out of text; a character whose bytes are cut in part is dropped (U+FFFD never arises)."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, whole: pa.Array, cover: pa.Array) -> pa.Array:
        return pa.array([_cut(*x)[0].decode("utf-8", "ignore") for x in zip(text.to_pylist(), whole.to_pylist(), cover.to_pylist(), strict=True)], pa.string())

    rows, names = _marked(docs)
    kept = F.when(F.col("text").isNotNull(), cut(*names)).alias("text")
    return rows.select(*[kept if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])
