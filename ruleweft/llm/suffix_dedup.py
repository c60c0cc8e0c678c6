"""Exact repeated passages across documents, by a logarithmic family of sparse suffix arrays.

A byte goes if a 100-byte string that covers it also starts earlier. Suffixes are sampled: each 100-byte window has an
anchor, its 32-gram of the lowest hash, so equal windows have equal anchors at equal places, and one anchor stands for
the run of windows around it (its span). A suffix array holds the anchors' suffixes ordered by their first 24 letters,
then by document and place, in buckets; 3 % of all suffixes are enough to meet every match of 100 bytes.

Documents come in batches of bounded size in order of their ids. A batch gets its suffix array, which is merge-scanned
with those of the family's levels: neighbours with equal letters may be parts of a long match, so they are noted, new
ones and old ones. Then levels of the new one's size merge with it, as a binary counter carries, so an entry is
rewritten a logarithmic number of times. The family is kept in a folder, and later batches may be added to it.

The noted anchors' surroundings are then fetched and compared: windows are found by hash and confirmed byte by byte, so
no collision removes text. Where letters are shared by very many different surroundings, these are dealt by longer
common parts (82 letters or more) instead. Surroundings that are equal within a task's slice of input are settled there,
byte by byte too, so what a frequent passage sends on is bounded by the number of slices.

Null and empty texts, and texts shorter than a match, lose nothing; very long texts are scanned in segments, with the
same result; rows that share a doc_id are one document, the one with the first text by order; rows without one are
returned untouched; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.llm.bytesops import U, Hasher, mix
from ruleweft.llm.common import flat_bytes, ids_and_text, n_parts, remove, shared_dir, slices, spread, stash
from ruleweft.llm.sharding import cuts

LENGTH, GRAM = 100, 32
#: Letters by which suffixes are ordered.
LETTERS = 24
#: Bytes of a batch, and batches of one run, at most: as each batch is scanned with all before, larger runs have larger
#: batches. Batches that are added to a kept family may have any size.
BATCH_BYTES, BATCHES = 512 << 20, 8
#: Bytes of text that a task settles among itself at a time, and that one scan's arrays hold.
SLICE, SEGMENT = 8 << 20, 512 << 10
#: Different surroundings of equal letters, in a slice or in all, from which they are dealt by longer parts.
SLICE_SPANS, ANCHOR_SPANS = 32, 4096
#: Windows whose places before the anchor lie in one of these ranges are dealt together by the part they share.
PARTS = ((0, 17), (18, 35), (36, 53), (54, 68))
#: Buckets for each shuffle partition, and bytes of all text for each bucket, at most.
BUCKETS, BUCKET_BYTES = 4, 64 << 20
REPEAT, BY_LETTERS, BY_PARTS = 1, 2, 3
CODEC = pa.Codec("zstd", compression_level=3)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: anchor's place, first and last window, row, and hash of the span."""
    w, m = length - k + 1, len(data) - k + 1
    if m < w:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U)
    h = Hasher(data)
    gram = mix((h.sums[k:] - h.sums[:-k]) * h.back[:m])
    low, size = (gram & U(0xFFFFFFFF00000000)) | np.arange(m, dtype=U), 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(len(at) + length + 1, np.int64)  # windows that lie within a row
    some = np.diff(offs) >= length
    fits[offs[:-1][some]] += 1
    fits[offs[1:][some] - length + 1] -= 1
    fits = np.cumsum(fits[: len(at)]) > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    last = np.flatnonzero(fits & np.append((new | ~fits)[1:], True))
    return at[first], first, last, np.searchsorted(offs, first, "right") - 1, h.spans(first, last + length)


def letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first letters of suffixes as big-endian words, whose order is that of the text."""
    if not len(at):
        return np.zeros((0, LETTERS // 8), U)
    return data[at[:, None] + np.arange(LETTERS)].view(">u8").astype(U)


def segments(batch: pa.RecordBatch, column: int, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row and start in the row of segments; long rows are cut so that each window is in one segment."""
    data, offs = flat_bytes(batch.column(column))
    bounds, row, start = [], [], []
    for r, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        if e - s < length:
            continue
        for a in range(s, max(s + 1, e - length + 1), SEGMENT):
            bounds.append((a, min(e, a + SEGMENT + length - 1)))
            row.append(r)
            start.append(a - s)
    i = 0
    while i < len(bounds):
        j, n = i, 0
        while j < len(bounds) and (j == i or n + bounds[j][1] - bounds[j][0] <= SEGMENT):
            n += bounds[j][1] - bounds[j][0]
            j += 1
        yield np.concatenate([data[a:b] for a, b in bounds[i:j]]), np.concatenate([[0], np.cumsum([b - a for a, b in bounds[i:j]])]), np.array(row[i:j]), np.array(start[i:j])
        i = j


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + CODEC.compress(raw, asbytes=True) if raw else b""


def unsqueezed(raw: bytes) -> bytes:
    return CODEC.decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True) if raw else b""


def packed(x: np.ndarray) -> bytes:
    """A column's little-endian bytes, place by place so that what is alike is together, compressed."""
    return squeezed(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) if len(x) else b""


def unpacked(raw: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(unsqueezed(r), np.uint8).reshape(size, -1).T).view(kind).ravel() for r in raw if r]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


#: Rows of a suffix array or of surroundings have a bucket; notes have arrays of documents, places and marks, or of
#: documents, first and last windows.
PACKED = "bucket int, n int, key binary, span binary, doc binary, at binary, mark binary, docs array<bigint>, a array<bigint>, b array<bigint>"
_LONGS = pa.list_(pa.int64())
_TYPES = [("bucket", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("span", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("mark", pa.binary()), ("docs", _LONGS), ("a", _LONGS), ("b", _LONGS)]
#: Notes in one row.
NOTES = 8192


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], t) for c, t in _TYPES], [c for c, _ in _TYPES])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows begin a new group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _bounds(*keys: np.ndarray) -> list[tuple[int, int]]:
    """First and last-but-one row of each group of sorted rows."""
    at = np.flatnonzero(_groups(*keys)).tolist()
    return list(zip(at, [*at[1:], len(keys[0])], strict=False))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """True where the ``n`` bytes from place ``a`` on are those from place ``b`` on."""
    out, i = np.ones(len(a), bool), 0
    ends = np.cumsum(n)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
        own = np.arange(i, j)
        differ = data[spread(own, a, n)] != data[spread(own, b, n)]
        sums = np.concatenate([[0], np.cumsum(differ)])
        stop = np.cumsum(n[i:j])
        out[i:j] = sums[stop] == sums[stop - n[i:j]]
        i = j
    return out


def repeats_of_first(data: np.ndarray, start: np.ndarray, n: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for stretches that equal, byte by byte, the first one (by document and place) of those with their hash."""
    order = np.lexsort((at, doc, n, h))
    head = _groups(h[order], n[order])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    late = order[~head]
    out = np.zeros(len(h), bool)
    out[late] = same_bytes(data, start[late], start[first[~head]], n[late])
    return out


def _notes(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Notes in order of documents and places."""
    order = np.lexsort((a, doc))
    return [{"docs": doc[x], "a": a[x].astype(np.int64), "b": b[x].astype(np.int64)} for i in range(0, len(order), NOTES) if len(x := order[i : i + NOTES])]


def _by_document(rows: DataFrame) -> DataFrame:
    """(doc_id, notes array<struct<a, b>>) of packed notes."""
    every = rows.where("docs IS NOT NULL").select(F.explode(F.arrays_zip("docs", "a", "b")).alias("x")).select(F.col("x.docs").alias("doc_id"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("notes"))


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The notes of all rows end to end, as two columns, and the n + 1 offsets of the rows; null has none."""
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten()
    sizes = np.asarray(pa.compute.list_value_length(column))
    return flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(key), U)
    for i in range(key.shape[1]):
        h = mix(h ^ key[:, i])
    return (h >> U(32)).astype(np.int64) % buckets


def _entries(key: np.ndarray, buckets: int, doc: np.ndarray, at: np.ndarray, mark: np.ndarray) -> list[dict]:
    """One row of packed entries for each bucket that has any; entries are sorted by bucket, then as suffixes."""
    bucket = _bucket_of(key, buckets)
    return [{"bucket": int(bucket[s])} | _entry(key[s:e], doc[s:e], at[s:e], mark[s:e]) for s, e in _bounds(bucket)]


def _entry(key: np.ndarray, doc: np.ndarray, at: np.ndarray, mark: np.ndarray) -> dict:
    return {"n": len(key), "key": packed(key.reshape(-1).view(f"V{LETTERS}")) if len(key) else b"", "doc": packed(doc), "at": packed(at), "mark": packed(mark.astype(np.int8))}


def _index(buckets: int):
    """A batch's suffix array, slice by slice: spans that equal an earlier one of the slice are noted at once, and so are
    letters with many spans, of which one entry stays."""

    def settle(parts: list[tuple[np.ndarray, ...]], data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, at, key, span, start, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
        again = repeats_of_first(np.concatenate(data), start, n, span, doc, at)
        notes = [(doc[again], at[again], REPEAT)]
        doc, at, key = doc[~again], at[~again], key[~again]
        order = np.lexsort((at, doc, *key.T[::-1], _bucket_of(key, buckets)))
        doc, at, key = doc[order], at[order], key[order]
        head = _groups(*key.T)
        of = np.cumsum(head) - 1
        many = np.bincount(of)[of] > SLICE_SPANS if len(of) else np.zeros(0, bool)
        notes.append((doc[many], at[many], BY_PARTS))
        keep = ~many | head
        rows = _notes(np.concatenate([x[0] for x in notes]), np.concatenate([x[1] for x in notes]), np.concatenate([np.full(len(x[0]), x[2]) for x in notes]))
        rows += _entries(key[keep], buckets, doc[keep], at[keep], np.where(many[keep], BY_PARTS, 0))
        for i in range(0, len(rows), 4096):
            yield _rows(rows[i : i + 4096])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[np.ndarray] = []
        size = 0
        for b in slices(batches, "text", SEGMENT):
            ids = b.column(0).to_numpy()
            for data, offs, row, start in segments(b, 1):
                s, first, last, own, span = anchors(data, offs)
                parts.append((ids[row[own]], s - offs[own] + start[own], letters(data, s), span, size + first, last - first + LENGTH))
                held.append(data)
                size += len(data)
            if size >= SLICE:
                yield from settle(parts, held)
                parts, held, size = [], [], 0
        if parts:
            yield from settle(parts, held)

    return run


def _scan(keep_level: bool):
    return lambda rows: _merge_scan(rows, keep_level)


def _merge_scan(rows: pa.Table, keep_level: bool = True) -> pa.Table:
    """Merge-scans a bucket's new suffix array (level 0) with those of the levels; notes, then the merged level."""
    level = rows.column("level").to_numpy()
    raw = {c: rows.column(c).to_pylist() for c in ("key", "doc", "at", "mark")}
    n = rows.column("n").to_numpy()
    key = unpacked(raw["key"], f"V{LETTERS}").view(U).reshape(-1, LETTERS // 8)
    doc, at, mark = (unpacked(raw[c], t) for c, t in (("doc", np.int64), ("at", np.int64), ("mark", np.int8)))
    fresh, stays = np.repeat(level == 0, n), np.repeat(rows.column("stays").to_numpy(zero_copy_only=False), n)
    order = np.lexsort((at, doc, *key.T[::-1]))
    key, doc, at, mark, fresh, stays = (x[order] for x in (key, doc, at, mark, fresh, stays))
    of = np.cumsum(_groups(*key.T)) - 1
    count = lambda x: np.bincount(of, weights=x, minlength=int(of[-1]) + 1)[of] if len(of) else np.zeros(0)
    entries, hot = count(np.ones(len(of))), count(mark == BY_PARTS) > 0
    hot |= entries > ANCHOR_SPANS
    touched = count(fresh) > 0
    want = np.where(hot, BY_PARTS, np.where(entries > 1, BY_LETTERS, 0)).astype(np.int8)
    tell = touched & (want > mark)
    out = _notes(doc[tell], at[tell], want[tell])
    if not keep_level:
        return pa.Table.from_batches([_rows(out)])
    # entries of levels that don't merge stay where they are; letters with very many entries keep one, as a mark
    own = np.flatnonzero(~stays)
    one = np.zeros(len(key), bool)
    one[own[_groups(of[own])]] = True
    keep = np.where(hot, one, ~stays)
    mark = np.where(touched, np.maximum(mark, want), mark)
    out.append({"bucket": rows.column("bucket")[0].as_py()} | _entry(key[keep], doc[keep], at[keep], mark[keep]))
    return pa.Table.from_batches([_rows(out)])


def _surroundings(buckets: int):
    """What the noted anchors stand for: surroundings to compare, and runs of windows that are settled already."""

    def settle(parts: list[tuple[np.ndarray, ...]], data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, h, doc, at, start, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
        text = np.concatenate(data)
        again = repeats_of_first(text, start, n, h, doc, at)
        rows = _runs(doc[again], at[again], (at + n - LENGTH)[again])
        key, doc, at, start, n = (x[~again] for x in (key, doc, at, start, n))
        bucket = (key >> U(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        for s, e in _bounds(bucket[order]):
            i = order[s:e]
            rows.append({"bucket": int(bucket[i[0]]), "n": len(i), "span": squeezed(text[spread(i, start, n)].tobytes()), "doc": packed(doc[i]), "at": packed(at[i]), "mark": packed(n[i].astype(np.int16))})
        for i in range(0, len(rows), 4096):
            yield _rows(rows[i : i + 4096])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[np.ndarray] = []
        size = 0
        for b in slices(batches, "text", SEGMENT):
            ids = b.column(0).to_numpy()
            told_at, told_mark, told = _pairs(b.column(2))
            rows: list[dict] = []
            for data, offs, row, start in segments(b, 1):
                s, first, last, own, _ = anchors(data, offs)
                place = s - offs[own] + start[own]
                mark = np.zeros(len(s), np.int8)
                lo = np.searchsorted(own, np.arange(len(row) + 1))
                for i, r in enumerate(row.tolist()):
                    at, m = told_at[told[r] : told[r + 1]], told_mark[told[r] : told[r + 1]]
                    a, z = lo[i], lo[i + 1]
                    j = np.searchsorted(place[a:z], at)
                    ok = j < z - a
                    ok[ok] = place[a:z][j[ok]] == at[ok]
                    np.maximum.at(mark, a + j[ok], m[ok])
                    gone = np.zeros(z - a, bool)
                    gone[j[ok & (m == REPEAT)]] = True
                    mark[a:z][gone] = REPEAT
                base = start[own] - offs[own]
                gone = mark == REPEAT
                rows += _runs(ids[row[own[gone]]], (first + base)[gone], (last + base)[gone])
                h, some = Hasher(data), []
                x = np.flatnonzero(mark == BY_LETTERS)
                some.append((h.spans(s[x], s[x] + GRAM), x, first[x], last[x]))
                x = np.flatnonzero(mark == BY_PARTS)
                for k, (near, far) in enumerate(PARTS):
                    a, z = np.maximum(first[x], s[x] - far), np.minimum(last[x], s[x] - near)
                    fit = a <= z
                    y = x[fit]
                    some.append((mix(h.spans(s[y] - near, s[y] + LENGTH - far) + U(k + 1)), y, a[fit], z[fit]))
                key, x, a, z = (np.concatenate([p[i] for p in some]) for i in range(4))
                if len(x):
                    parts.append((key, h.spans(a, z + LENGTH), ids[row[own[x]]], a + base[x], size + a, z - a + LENGTH))
                    held.append(data)
                    size += len(data)
            for i in range(0, len(rows), 4096):
                yield _rows(rows[i : i + 4096])
            if size >= SLICE:
                yield from settle(parts, held)
                parts, held, size = [], [], 0
        if parts:
            yield from settle(parts, held)

    return run


def _runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Notes of runs of repeated windows: first and last one."""
    return _notes(doc, first, last)


def late_windows(data: np.ndarray, p: np.ndarray, doc: np.ndarray, at: np.ndarray, h: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True for windows (at place ``p`` of ``data``) that equal, byte by byte, one of an earlier document or place."""
    order = np.lexsort((at, doc, h))
    head = _groups(h[order])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    # the same window may be there more than once
    same = (doc[order] == doc[first]) & (at[order] == at[first])
    late = np.zeros(len(p), bool)
    late[order[~head & ~same]] = True
    of = np.zeros(len(p), np.int64)
    of[order] = first
    # runs of windows that follow each other, as the first ones do, are confirmed as one stretch
    x = np.flatnonzero(late)
    if not len(x):
        return late
    a, b = p[x], p[of[x]]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)])
    n = np.diff(np.append(cut, len(x))) + length - 1
    fine = same_bytes(data, a[cut], b[cut], n)
    if not fine.all():  # collisions: the windows of these hashes by their bytes
        doubt = np.isin(h, np.unique(h[x[np.repeat(~fine, n - length + 1)]]))
        y = np.flatnonzero(doubt)
        text = data[p[y][:, None] + np.arange(length)]
        kind = np.unique(text.view(f"V{length}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((at[y], doc[y], kind))
        head = _groups(kind[order])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        late[y] = False
        late[y[order]] = ~head & ~((doc[y][order] == doc[y][first]) & (at[y][order] == at[y][first]))
    return late


def _compare(rows: pa.Table) -> pa.Table:
    """Windows of a bucket's surroundings that also start earlier, as notes: runs of them."""
    raw = {c: rows.column(c).to_pylist() for c in ("span", "doc", "at", "mark")}
    data = np.frombuffer(b"".join(map(unsqueezed, raw["span"])), np.uint8)
    doc, at, size = (unpacked(raw[c], t) for c, t in (("doc", np.int64), ("at", np.int64), ("mark", np.int16)))
    size = size.astype(np.int64)
    start, h = np.cumsum(size) - size, Hasher(data)
    # surroundings that equal an earlier one as a whole; the windows of the others
    again = repeats_of_first(data, start, size, h.spans(start, start + size), doc, at)
    out = _runs(doc[again], at[again], (at + size - LENGTH)[again])
    doc, at, size, start = (x[~again] for x in (doc, at, size, start))
    n = size - LENGTH + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = np.repeat(start, n) + inner
    doc, at = np.repeat(doc, n), np.repeat(at, n) + inner
    late = late_windows(data, p, doc, at, h.spans(p, p + LENGTH))
    doc, at = doc[late], at[late]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    out += _runs(doc[cut], at[cut], at[np.append(cut[1:], len(doc)) - 1] if len(cut) else cut)
    return pa.Table.from_batches([_rows(out)])


def covered(n: int, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that runs of repeated windows cover in a text of ``n`` bytes."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.r_[True, first[1:] > end[:-1]]
    return first[new], np.minimum(end[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)], n)


class Family:
    """Suffix arrays of all documents so far, in levels of geometric sizes, kept in a folder.

    ``add`` takes the next batch, whose ids must be above all earlier ones; ``repeats`` says which windows of all texts
    so far start earlier too. Each change is written under a new number, and the folder of the last whole one counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        #: levels: [size in batches, folder], oldest first, with their notes; top: the highest id; n: batches so far.
        self.state = self._last() or {"n": 0, "top": None, "levels": [], "buckets": buckets or BUCKETS * n_parts(spark)}

    def _last(self) -> dict | None:
        folder = self._hadoop(f"{self.path}/states")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = sorted((int(m[1]) for x in names if (m := re.fullmatch(r"(\d+)", x))), reverse=True)
        for k in numbers:
            rows = self.spark.read.text(f"{self.path}/states/{k}").collect() if self._fs.exists(self._hadoop(f"{self.path}/states/{k}/_SUCCESS")) else []
            if rows:
                return json.loads(rows[0]["value"])
        return None

    def _commit(self, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/states/{state['n']}")
        self.state = state

    def add(self, texts: DataFrame, last: bool = False) -> None:
        """Indexes a batch (doc_id, text), ids not null and unique, and scans it with all levels.

        After the ``last`` batch only notes are kept, and no more can be added.
        """
        low, high = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is None:
            return
        state = json.loads(json.dumps(self.state))
        if state["top"] is not None and low <= state["top"]:
            raise ValueError(f"ids of a new batch must be above {state['top']}")
        if any(n == 0 for n, _ in state["levels"]):
            raise ValueError("the last batch was added already")
        where = f"{self.path}/batch{state['n']}-{uuid.uuid4().hex[:8]}"
        fresh = stash(texts.mapInArrow(_index(state["buckets"]), PACKED), f"{where}/array")
        size, merged = 1, []
        while not last and state["levels"] and state["levels"][-1][0] == size:  # a binary counter of batches
            merged.append(state["levels"].pop()[1])
            size *= 2
        read = lambda folder: self.spark.read.schema(PACKED).parquet(folder)
        entries = fresh.where("bucket IS NOT NULL").withColumn("level", F.lit(0)).withColumn("stays", F.lit(False))
        notes = fresh.where("docs IS NOT NULL")
        for k, folder in enumerate([*merged, *(f for _, f in state["levels"])]):
            old = read(folder)
            entries = entries.unionByName(old.where("bucket IS NOT NULL").withColumn("level", F.lit(k + 1)).withColumn("stays", F.lit(k >= len(merged))))
            notes = notes.unionByName(old.where("docs IS NOT NULL")) if k < len(merged) else notes
        # a level keeps the notes of the batches in it
        stash(entries.groupBy("bucket").applyInArrow(_scan(not last), PACKED).unionByName(notes), f"{where}/level")
        self._commit(state | {"n": state["n"] + 1, "top": high, "levels": [*state["levels"], [0 if last else size, f"{where}/level"]]})
        for folder in (f"{where}/array", *merged):
            remove(self.spark, folder)

    def repeats(self, texts: DataFrame, where: str) -> DataFrame:
        """(doc_id, notes array<struct<a, b>>) of the documents of ``texts`` (all that were added) with repeated
        windows: first and last ones of their runs; written below ``where``."""
        folders = [f for _, f in self.state["levels"]]
        notes = self.spark.read.schema(PACKED).parquet(*folders) if folders else self.spark.createDataFrame([], PACKED)
        marked = texts.join(_by_document(notes), "doc_id").select("doc_id", "text", "notes")
        seen = stash(marked.mapInArrow(_surroundings(self.state["buckets"]), PACKED), f"{where}/surroundings")
        late = seen.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_compare, PACKED)
        found = stash(_by_document(seen.unionByName(late)), f"{where}/found")
        remove(self.spark, f"{where}/surroundings")
        return found


def repeats(texts: DataFrame, where: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, notes) of documents with repeated windows; ids unique and not null."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    family = Family(spark, f"{where}/family", max(BUCKETS * n_parts(spark), -(-total // BUCKET_BYTES)))
    firsts = cuts(texts, max(batch_bytes, -(-total // BATCHES)), f"{where}/sizes") if total > batch_bytes else []
    bounds = [None, *firsts[1:], None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = texts if lo is None else texts.where(F.col("doc_id") >= F.lit(int(lo)))
        family.add(part if hi is None else part.where(F.col("doc_id") < F.lit(int(hi))), last=hi is None)
    found = family.repeats(texts, where)
    for name in ("family", "sizes"):
        remove(spark, f"{where}/{name}")
    return found


def _cut(texts: list[bytes], notes: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    first, last, offs = _pairs(notes)
    for t, a, z in zip(texts, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if a == z:
            yield t, first[:0], first[:0]
            continue
        s, e = covered(len(t), first[a:z], last[a:z])
        ends, starts = [0, *e.tolist()], [*s.tolist(), len(t)]
        yield b"".join(t[a:b] for a, b in zip(ends, starts, strict=True)), s, e


def _unique(docs: DataFrame, where: str) -> DataFrame:
    """Rows with an id, one for each: the first by text, the same on every run."""
    some = docs.where("doc_id IS NOT NULL")
    n = some.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n[0] == n[1]:
        return some
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = some.groupBy("doc_id").agg(F.min(F.struct(F.col("text").alias("t"), F.struct(*rest).alias("r") if rest else F.lit(0).alias("r"))).alias("x"))
    out = first.select("doc_id", F.col("x.t").alias("text"), "x.r.*") if rest else first.select("doc_id", F.col("x.t").alias("text"))
    return stash(out.select(*docs.columns), f"{where}/unique")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Digests of what is left of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    The folder ``found``, which the result reads, stays in the shared folder.
    """
    where = shared_dir(docs.sparkSession)
    rows = ids_and_text(docs)
    one = _unique(rows, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offs = flat_bytes(b.column(1))
            raw, offs = data.tobytes(), offs.tolist()
            out: tuple[list, ...] = ([], [], [], [])
            for (s, e), (kept, a, z) in zip(zip(offs, offs[1:], strict=False), _cut([raw[s:e] for s, e in zip(offs, offs[1:], strict=False)], b.column(2)), strict=True):
                for c, v in zip(out, (e - s, int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(one, where, batch_bytes)
    bare = rows.where("doc_id IS NULL").withColumn("notes", F.lit(None).cast(found.schema["notes"].dataType))
    return one.join(found, "doc_id", "left").select("doc_id", "text", "notes").unionByName(bare).mapInArrow(run, RESULT)


def without_repeats(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (characters cut in two go whole) and ``n_chars`` to match."""
    where = shared_dir(docs.sparkSession)
    one = _unique(docs, where)
    found = repeats(ids_and_text(one), where, batch_bytes)
    own = "_notes"
    while own in docs.columns:
        own = f"_{own}"
    bare = docs.where("doc_id IS NULL").withColumn(own, F.lit(None).cast(found.schema["notes"].dataType))
    both = one.join(found.withColumnRenamed("notes", own), "doc_id", "left").select(*docs.columns, own).unionByName(bare)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            null = np.array(b.column(at).is_null())
            data, offs = flat_bytes(b.column(at))
            raw, offs = data.tobytes(), offs.tolist()
            texts = [k.decode("utf-8", "ignore") for k, _, _ in _cut([raw[s:e] for s, e in zip(offs, offs[1:], strict=False)], b.column(len(names)))]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string(), mask=null)
            yield pa.record_batch(cols, names)

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
