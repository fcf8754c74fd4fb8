"""Substring dedup with difference-cover anchors.

A word goes if it lies in a window of WINDOW consecutive words whose sequence also starts
earlier: in a smaller doc_id, or in the same document at a smaller position.

Comparing all windows would send every position around.  Instead only positions i with
i mod PERIOD in COVER carry an anchor, the hash of the ANCHOR words there.  COVER is a
difference cover: for any two positions i, j some shift d < PERIOD brings both i + d and j + d
into it, and PERIOD - 1 + ANCHOR = WINDOW, so any two equal windows hold
an anchor at the same place.  Hence:

1. anchors are grouped by hash; those that occur once are done with;
2. windows around the others are extended to their full length and hashed;
3. of the windows with one hash all but the first are marked, and the words they cover go.

Hashes travel packed by hash range, and every task first settles what it can
by itself: of the equal windows (anchors) of a slice of texts only the first is sent.
A passage that a third of all documents share so costs one entry a slice.  Ranges are cut
so that a range's distinct hashes fit in memory; they are read as a stream.

Equality of windows is equality of 64-bit hashes of their words.  Positions are (key, start); a
document's key is its doc_id or, if a doc_id comes more than once, a number in the order of (doc_id,
hash of the text).  Defined cases: rows with the same doc_id and text are one document and
keep the same words; different texts under one doc_id (also null) are documents of their own; null doc_id comes
first; null, empty and short texts have no windows and keep all words; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm import wordhash as wh
from lapse.llm.common import stage

#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
ANCHOR = WINDOW - PERIOD + 1
IN_COVER = np.isin(np.arange(PERIOD), COVER)
NO_ID = np.iinfo(np.int64).min
#: Positions of a hash range, about, and marked positions that a task holds before it writes them.
RANGE_WORDS = 1 << 17
HELD = 1 << 21

PACKED = "range long, hashes binary, docs binary, places binary"


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array as binary values, byte by byte (all first bytes, then all second ones, ..), which
    compresses well where high bytes are equal; cuts has one more entry than there are slices."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    c = cuts.tolist()
    return pa.array([raw[i:j].T.tobytes() for i, j in zip(c[:-1], c[1:])], pa.binary())


def _values(x: pa.Scalar, kind: type) -> np.ndarray:
    """A slice written by ``_blobs``."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _steps(doc: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Differences of the ids from one entry to the next, from 0 at each cut (modulo 2^64)."""
    d = doc.view(np.uint64)
    out = np.diff(d, prepend=np.uint64(0))
    out[cuts[:-1]] = d[cuts[:-1]]
    return out.view(np.int64)


def _ids_of(x: pa.Scalar) -> np.ndarray:
    return np.cumsum(_values(x, np.uint64), dtype=np.uint64).view(np.int64)


def _first_of_each(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, doc, at), of entries equal in all three only one, and whether each in that order is the
    first of its hash."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if not new.all():
        run = np.cumsum(new)
        many = np.bincount(run)[run] > 1
        part = order[many]
        order[many] = part[np.lexsort((at[part], doc[part], h[part]))]
        again = np.zeros(len(s), bool)
        again[1:] = ~new[1:] & (doc[order[1:]] == doc[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
        order, new = order[~again], new[~again]
    return order, new


def _doc_range(doc: np.ndarray, bits: int) -> np.ndarray:
    """Hash range of a document: 16 times coarser than those of windows, so that marks travel in long runs."""
    fine = min(4, bits - 6)
    return (wh.mix(doc.view(np.uint64)) >> wh.U(64 - bits + fine)) << wh.U(fine)


def _mark_rows(doc: np.ndarray, at: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """Marked positions as rows by their documents' hash range (no hashes)."""
    if not len(doc):
        return None
    r = _doc_range(doc, bits)
    order = np.lexsort((at, doc, r))
    r, doc, at = r[order], doc[order], at[order]
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))), [len(r)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(r[cuts[:-1]].astype(np.int64)), pa.nulls(len(cuts) - 1, pa.binary()), _blobs(_steps(doc, cuts), cuts),
         _blobs(at.astype(np.int32), cuts)], names=["range", "hashes", "docs", "places"])


def _pack(h: np.ndarray, doc: np.ndarray, at: np.ndarray, bits: int, all_of_many: bool) -> Iterator[pa.RecordBatch]:
    """The first of each hash as rows by hash range; the others (with ``all_of_many`` also the first,
    if there are others) as marks."""
    order, new = _first_of_each(h, doc, at)
    if not new.all():
        run = np.cumsum(new)
        marked = order[(np.bincount(run)[run] > 1) if all_of_many else ~new]
        yield _mark_rows(doc[marked], at[marked], bits)
    order = order[new]
    if not len(order):
        return
    # by range, in it by place: there the steps from one id to the next are small
    r = h[order] >> wh.U(64 - bits)
    order = order[np.lexsort((order, r))]
    h = h[order]
    r = h >> wh.U(64 - bits)
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))), [len(r)]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(r[cuts[:-1]].astype(np.int64)), _blobs(h, cuts), _blobs(_steps(doc[order], cuts), cuts),
         _blobs(at[order].astype(np.int32), cuts)], names=["range", "hashes", "docs", "places"])


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return wh.utf8(b.column("text")) + (b.column("key").to_numpy(),)


def _anchors(bits: int) -> Callable:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, ids = _read(b)
            for i, j in wh.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                start, end, first = wh.words(d, o)
                n = np.diff(first)
                doc = np.repeat(np.arange(j - i), n)
                at = np.arange(len(start)) - first[doc]
                pick = np.flatnonzero(IN_COVER[at % PERIOD] & (at + ANCHOR <= n[doc]) & (n[doc] >= WINDOW))
                h = wh.window_hashes(wh.word_hashes(d, start, end), ANCHOR)[pick] if len(pick) else np.zeros(0, np.uint64)
                yield from _pack(h, ids[i:j][doc[pick]], at[pick], bits, True)

    return anchors


def _windows(bits: int) -> Callable:
    """From (key, text, places of repeated anchors) the hashes of all windows that hold one of them in place."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, ids = _read(b)
            lists = b.column("places")
            for i, j in wh.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                start, end, first = wh.words(d, o)
                n = np.diff(first)
                near = np.zeros(len(start) + 1, np.int64)
                for k in range(i, j):
                    if n[k - i] >= WINDOW:
                        at = _values(lists[k], np.int32)
                        np.add.at(near, first[k - i] + np.maximum(at - PERIOD + 1, 0), 1)
                        np.add.at(near, first[k - i] + at + 1, -1)
                doc = np.repeat(np.arange(j - i), n)
                at = np.arange(len(start)) - first[doc]
                pick = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (at + WINDOW <= n[doc]))
                h = wh.window_hashes(wh.word_hashes(d, start, end), WINDOW)[pick] if len(pick) else np.zeros(0, np.uint64)
                yield from _pack(h, ids[i:j][doc[pick]], at[pick], bits, False)

    return windows


def _settle(bits: int, all_of_many: bool) -> Callable:
    """Over rows ordered by range: marks of the equal hashes of all tasks (and the marks that come along)."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list = []
        held: list = []                  # rows of the range at hand, not yet settled
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        known = none                     # the range's first positions so far, and whether they are marked
        current, size, n_marks = None, 0, 0

        def merge():
            """Merge what is held into the first positions; returns what turns out to be repeated."""
            h, doc, at = (np.concatenate([known[i], *[x[i] for x in held]]) for i in range(3))
            done = np.concatenate((known[3], np.zeros(len(h) - len(known[3]), bool)))
            order, new = _first_of_each(h, doc, at)
            run = np.cumsum(new)
            repeated = np.bincount(run)[run] > 1
            marked = order[(repeated & ~done[order]) if all_of_many else ~new]
            first = order[new]
            old = np.zeros(len(first), bool)
            if all_of_many:
                np.logical_or.at(old, run - 1, repeated | done[order])
            return (h[first], doc[first], at[first], old), (doc[marked], at[marked])

        def out():
            return _mark_rows(np.concatenate([x[0] for x in marks]), np.concatenate([x[1] for x in marks]), bits)

        for b in batches:
            ranges = b.column("range").to_numpy()
            for k in range(b.num_rows):
                doc = _ids_of(b.column("docs")[k])
                at = _values(b.column("places")[k], np.int32).astype(np.int64)
                if not b.column("hashes")[k].is_valid:
                    marks.append((doc, at))
                    n_marks += len(doc)
                    continue
                if held and (ranges[k] != current or size > HELD):
                    known, found = merge()
                    marks.append(found)
                    n_marks += len(found[0])
                    held, size = [], 0
                if ranges[k] != current:
                    known, current = none, ranges[k]
                held.append((_values(b.column("hashes")[k], np.uint64), doc, at))
                size += len(doc)
                if n_marks > HELD:
                    yield out()
                    marks, n_marks = [], 0
        if held:
            known, found = merge()
            marks.append(found)
            n_marks += len(found[0])
        if n_marks:
            yield out()

    return settle


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of marks ordered by range: one row for each document."""
    held, current = [], None

    def out():
        doc, at = (np.concatenate([x[i] for x in held]) for i in range(2))
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), [len(doc)]))
        for i in range(0, len(cuts) - 1, 1 << 15):
            c = cuts[i:i + (1 << 15) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(doc[c[:-1]]), _blobs(at[c[0]:c[-1]], c - c[0])], ["key", "places"])

    for b in batches:
        ranges = b.column("range").to_numpy()
        for k in range(b.num_rows):
            if held and ranges[k] != current:
                yield from out()
                held = []
            current = ranges[k]
            held.append((_ids_of(b.column("docs")[k]), _values(b.column("places")[k], np.int32)))
    if held:
        yield from out()


def _marked(packed: DataFrame, bits: int, all_of_many: bool) -> DataFrame:
    """Marks over all tasks' rows: key, places (packed positions), one row for each document with any."""
    rows = packed.repartition("range").sortWithinPartitions("range").mapInArrow(_settle(bits, all_of_many), PACKED)
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(_by_document, "key long, places binary")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = wh.utf8(b.column("text"))
        lists = b.column("places")
        for i, j in wh.slices(off):
            d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            start, end, first = wh.words(d, o)
            cover = np.zeros(len(start) + 1, np.int64)
            for k in range(i, j):
                if lists[k].is_valid:
                    at = _values(lists[k], np.int32) + first[k - i]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
            kept = np.cumsum(cover)[:-1] == 0
            gone = np.concatenate(([0], np.cumsum(~kept)))
            # the bytes of kept words, and one blank after each but a text's last
            doc = np.repeat(np.arange(j - i), np.diff(first))[kept]
            last = np.ones(len(doc), bool)
            last[:-1] = doc[1:] != doc[:-1]
            inside = np.zeros(len(d) + 1, np.int64)
            inside[start[kept]] += 1
            np.add.at(inside, end[kept], -1)
            mask = np.cumsum(inside)[:-1] > 0
            mask[end[kept][~last]] = True
            body = np.where(wh.SPACE[d], np.uint8(32), d)[mask]
            at = np.concatenate(([0], np.cumsum(mask)))[o]
            text = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(gone[first[1:]] - gone[first[:-1]]),
                 text.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _keyed(d: DataFrame) -> DataFrame:
    """``d`` with ``key``: one for each distinct (doc_id, text), in the order of doc_id (null first), then a hash of the text."""
    own = F.coalesce("doc_id", F.lit(NO_ID))
    if not d.groupBy(own.alias("key")).count().where("count > 1").limit(1).count():
        return d.withColumn("key", own)
    t = d.withColumn("_hash", F.xxhash64("text"))
    order = [F.col("_id").asc_nulls_first(), F.col("_text")]
    each = t.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).distinct()
    each = stage(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "substr-keys")
    joined = t.join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")))
    return stage(joined.select("doc_id", "text", "key"), "substr-documents")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept words, joined by one blank)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = _keyed(d)
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(6, (size // 6 // RANGE_WORDS).bit_length())     # ranges: about a word every 6 bytes
    anchors = _marked(d.mapInArrow(_anchors(bits), PACKED), bits, True)

    def with_places(marked: DataFrame, how: str) -> DataFrame:
        return d.join(marked.hint("shuffle_hash"), "key", how).select("doc_id", "key", "text", "places")

    windows = _marked(with_places(anchors, "inner").mapInArrow(_windows(bits), PACKED), bits, False)
    return with_places(windows, "left").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")
