"""Long exact spans shared between records.

Texts are cut into sentences at marks that depend only on nearby characters, so
a stretch that stands in two texts is cut alike in both.  Every run of
consecutive sentences of at least ``run_chars`` is hashed; runs are joined
globally and those that stand in more than one record are kept.  Around these,
windows of exactly the wanted length decide whether the shared stretch is long
enough.  Nothing is paired within a group of equal runs: groups are reduced to
the least and greatest record that holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import BROADCAST_ROWS, checkpoint, maybe_broadcast

#: Distance kept between a sentence's ends and the marks that cut long sentences.
CLEAR = 32
#: Every stretch of that many bytes inside a long sentence has a mark.
WINNOW = 32
STEP = 16
#: A shared stretch holds a run that begins at most so many bytes after it: the gap between marks, and their context.
REACH = 2 * CLEAR + WINNOW + WINNOW + 8
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64."""
    size = 1 << max(10, (n - 1).bit_length())
    inv = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(size, inv, np.uint64)], dtype=np.uint64)
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a byte array from prefix sums, in constant time."""

    def __init__(self, data: np.ndarray, base: int = _A):
        up, self.down = _powers(len(data) + 1, base)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _slide(h: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over every window of ``w`` (a power of two)."""
    n = 1
    while n < w:
        h = op(h[:-n], h[n:])
        n *= 2
    return h


def marks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where a unit begins, from nearby bytes alone.

    ``data`` holds texts one after the other, beginning at ``starts``.  A sentence
    ends at a line break or at ``.``, ``!`` or ``?`` before a blank.  Further than
    ``CLEAR`` from any such end, the bytes that are least by hash in some window
    of ``WINNOW`` are marks as well, which cuts long sentences, texts without
    punctuation and scripts with other marks.  The beginning of a text is none.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    blank = (data == 32) | (data == 10) | (data == 13) | (data == 9)
    stop = (data == 46) | (data == 33) | (data == 63)
    ends = np.flatnonzero((data[:-1] == 10) & (data[1:] != 10) | stop[:-1] & blank[1:]) + 1
    if len(data) > 2 * WINNOW + 8:
        with np.errstate(over="ignore"):
            h, b = data.astype(np.uint64), np.uint64(_B)
            for k in (1, 2, 4):
                h = h[:-k] * b + h[k:]
                b = b * b
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(_A) >> np.uint64(32)).astype(np.uint32)
        high = _slide(_slide(h, WINNOW, np.minimum), WINNOW, np.maximum)
        # a position is chosen if it is the least of one of the windows over it
        at = np.flatnonzero(h[WINNOW - 1 : WINNOW - 1 + len(high)] == high) + WINNOW - 1
        border = np.r_[-CLEAR, ends, len(data) + CLEAR]
        after = np.searchsorted(border, at, "right")
        at = at[(at - border[after - 1] >= CLEAR) & (border[after] - at >= CLEAR)]
        ends = np.union1d(ends, at)
    return np.setdiff1d(ends, starts, assume_unique=False)


def _chunks(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of a text column in runs of rows of about ``most`` bytes:
    the first row's number, the bytes, and where each row begins (and the last
    ends).  Nothing is copied; nulls are empty."""
    col = batch.column(at)
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if not len(col) or col.buffers()[2] is None:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _emit_runs(run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, begin in _chunks(batch, 1):
                m = marks(data, begin)
                if not len(m):
                    continue
                # the shortest run of whole units from each mark on that is long enough
                to = np.searchsorted(m, m + run_bytes, "left")
                m, to = m[to < len(m)], m[np.minimum(to, len(m) - 1)][to < len(m)]
                owner = np.searchsorted(begin, m, "right") - 1
                ok = to < begin[owner + 1]
                m, to, owner = m[ok], to[ok], owner[ok]
                if len(m):
                    h = Hashes(data).of(m, to).view(np.int64)
                    s, e = m - begin[owner], to - begin[owner]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + row)), pa.array(h), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "h", "s", "e"])

    return run


def runs(documents: DataFrame, run_chars: int) -> DataFrame:
    """``doc_id, h, s, e``: every run of sentences, with its place in bytes."""
    return documents.mapInArrow(_emit_runs(run_chars), "doc_id long, h long, s int, e int")


def repeated(spans: DataFrame) -> DataFrame:
    """``h, first_doc`` of the runs that stand in more than one record.

    An aggregation with map-side combine: a passage that stands in a third of
    all records sends one row per task, and no pairs arise.
    """
    return spans.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last")).filter("first_doc < _last").select("h", "first_doc")


def _emit_windows(sizes: tuple[int, ...], back: tuple[int, ...]):
    """Hashes of the windows of each of ``sizes`` characters that begin each of
    ``back`` characters before the places asked for."""
    back = np.array(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            asked = batch.column(2)
            counts = np.diff(np.asarray(asked.offsets))
            every = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.r_[0, np.cumsum(counts)]
            for row, data, begin in _chunks(batch, 1):
                rows = np.arange(row, row + len(begin) - 1)
                owner = np.repeat(rows - row, counts[rows])
                places = every[first[row] : first[row + len(begin) - 1]] + begin[owner]
                # characters: where each begins, and the end
                char = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
                at = np.searchsorted(char, places)
                low, high = np.searchsorted(char, begin[:-1]), np.searchsorted(char, begin[1:])
                start = (at[:, None] - back[None, :]).ravel()
                own = np.repeat(owner, len(back))
                keep = start >= low[own]
                start, at_first = np.unique(start[keep], return_index=True)
                own = own[keep][at_first]
                a, b = Hashes(data), Hashes(data, _B)
                for kind, size in enumerate(sizes):
                    ok = start + size <= high[own]
                    if ok.any():
                        s, e, o = char[start[ok]], char[start[ok] + size], own[ok]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(o + row)), pa.array(a.of(s, e).view(np.int64)), pa.array(b.of(s, e).view(np.int64)), pa.array((s - begin[o]).astype(np.int32)), pa.array(np.full(len(s), kind, np.int32))],
                            names=["doc_id", "h1", "h2", "s", "kind"],
                        )

    return run


def _emit_starts(size: int, back: int, run_bytes: int):
    """Hashes of the windows of ``size`` characters that begin up to ``back``
    characters before the places asked for, and where in bytes they begin and end.

    A window that stands elsewhere holds only repeated runs; those with another
    run, clear of both ends by the context of marks, are left out.
    """
    clear = WINNOW + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            asked = batch.column(2)
            counts = np.diff(np.asarray(asked.offsets))
            every = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.r_[0, np.cumsum(counts)]
            for row, data, begin in _chunks(batch, 1):
                rows = np.arange(row, row + len(begin) - 1)
                owner = np.repeat(rows - row, counts[rows])
                if not len(owner):
                    continue
                places = every[first[row] : first[row + len(begin) - 1]] + begin[owner]
                char = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
                low, high = np.searchsorted(char, begin[:-1]), np.searchsorted(char, begin[1:])
                at = np.searchsorted(char, places)
                change = np.zeros(len(char) + 1, np.int64)
                np.add.at(change, np.maximum(at - back, low[owner]), 1)
                np.add.at(change, at + 1, -1)
                m = marks(data, begin)
                to = np.searchsorted(m, m + run_bytes, "left")
                m, to = m[to < len(m)], m[np.minimum(to, len(m) - 1)][to < len(m)]
                ok = (to < begin[np.searchsorted(begin, m, "right")]) & ~np.isin(m, places)
                first_out = np.searchsorted(char, to[ok] + clear) - size
                last_out = np.searchsorted(char, m[ok] - clear, "right") - 1
                own = np.searchsorted(begin, m[ok], "right") - 1
                first_out = np.maximum(first_out, low[own])
                ok = first_out <= last_out
                out = np.zeros(len(char) + 1, np.int64)
                np.add.at(out, first_out[ok], 1)
                np.add.at(out, last_out[ok] + 1, -1)
                start = np.flatnonzero((np.cumsum(change) > 0) & (np.cumsum(out) == 0))
                own = np.searchsorted(low, start, "right") - 1
                ok = start + size <= high[own]
                start, own = start[ok], own[ok]
                if len(start):
                    s, e = char[start], char[start + size]
                    a, b = Hashes(data).of(s, e), Hashes(data, _B).of(s, e)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own + row)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array((s - begin[own]).astype(np.int32)), pa.array((e - begin[own]).astype(np.int32))],
                        names=["doc_id", "h1", "h2", "s", "e"],
                    )

    return run


_WINDOWS = "doc_id long, h1 long, h2 long, s int, kind int"


def _with_places(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Documents with the places asked for; the text moves only if the list of
    places is too long to be broadcast."""
    size = places.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n_places")).first()
    # at most 8 MB of places and their ids
    few = size["n"] <= BROADCAST_ROWS // 4 and size["n_places"] <= 5 * BROADCAST_ROWS
    p = F.broadcast(places) if few else places
    return documents.join(p.withColumnRenamed("doc_id", "_p"), F.col("doc_id") == F.col("_p")).select("doc_id", "text", "places")


def _shared_windows(windows: DataFrame) -> DataFrame:
    # hashed once, then read by the aggregation and by the join with it
    windows = checkpoint(windows)
    met = windows.groupBy("h1", "h2", "kind").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b")
    return windows.join(met.select("h1", "h2", "kind"), ["h1", "h2", "kind"]).select("doc_id", "h1", "h2", "s", "kind")


def long_shared(documents: DataFrame, doc_id: str, text: str, least: int = 400, run_chars: int = 128) -> tuple[DataFrame, DataFrame]:
    """``(found, spans)``.

    ``found``: ``doc_id`` of the records with a stretch of at least ``least``
    characters that stands unchanged in a record with another id.  ``spans``:
    the repeated runs ``doc_id, h, s, e, first_doc``.

    Texts are read three times: for the runs, for the places of the repeated ones,
    and for the texts that hold such places, which are kept for all windows.

    Marks lie at most ``2 * CLEAR + WINNOW`` bytes apart and depend on less than
    ``WINNOW + 8`` bytes around them, so any shared stretch of ``least``
    characters holds a run wholly inside and begins at most ``reach`` before it;
    nothing is missed for ``least`` of 400 and up; a ``least`` under ``run_chars``
    and two reaches is refused.  Lengths are counted in characters.
    Null and empty texts share nothing; a stretch repeated within one record
    doesn't count; rows of the same id are one record; null ids are left out;
    extra columns are ignored.
    """
    # a run can end up to one gap later than run_chars, after up to one gap and the context at either end
    reach = REACH
    if least < 2 * reach + run_chars:
        raise ValueError(f"stretches under {2 * reach + run_chars} characters may hold no run of {run_chars}")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    long_enough = docs.filter(F.length("text") >= least)
    spans = runs(long_enough, run_chars)
    twice = checkpoint(repeated(spans.select("doc_id", "h")))
    hit = checkpoint(spans.join(maybe_broadcast(twice), "h"))

    # the places of one document are as many as its own sentences
    gathered = lambda hits: checkpoint(hits.groupBy("doc_id").agg(F.collect_set("s").alias("places")))
    near_texts = checkpoint(_with_places(long_enough, gathered(hit)))

    def shared(hits: DataFrame | None, sizes: tuple[int, ...], back: tuple[int, ...]) -> DataFrame:
        texts = near_texts if hits is None else _with_places(near_texts.drop("places"), gathered(hits))
        return checkpoint(_shared_windows(texts.mapInArrow(_emit_windows(sizes, back), _WINDOWS)))

    # most shared stretches hold a whole window from one of their marks on
    found = shared(None, (least,), (0,)).select("doc_id").distinct()
    # the rest may begin up to reach before their first mark: windows every STEP characters
    # there, of which one lies inside if the stretch is long enough, for all records that
    # hold a run of a record still open
    open_runs = hit.join(found, "doc_id", "left_anti").select("h").distinct()
    coarse = shared(hit.join(open_runs, "h", "left_semi"), (least, least - STEP + 1), tuple(range(0, reach + STEP, STEP)))
    found = checkpoint(found.unionByName(coarse.filter("kind = 0").select("doc_id")).distinct())
    # what shares only the shorter window is looked at character by character
    near = coarse.filter("kind = 1")
    unsure = near.join(found, "doc_id", "left_anti").select("h1", "h2").distinct()
    fine = shared(near.join(unsure, ["h1", "h2"], "left_semi"), (least,), tuple(range(STEP)))
    return found.unionByName(fine.select("doc_id")).distinct(), hit


def verified(documents: DataFrame, doc_id: str, spans: DataFrame, least: int = 400, text: str = "text", run_chars: int = 128) -> DataFrame:
    """``doc_id, s, e, first_doc``: every window of ``least`` characters that stands
    in more than one record, by its bytes, and the least record that holds it.

    A shared window begins at most ``REACH`` before one of its repeated runs
    (``spans``), so all windows that begin there are compared, character by
    character; their union is the maximal shared stretches.  Rows arise per
    character of such stretches, not per character of the table, and no pairs.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") >= least))
    places = checkpoint(spans.groupBy("doc_id").agg(F.collect_set("s").alias("places")))
    windows = _with_places(docs, places).mapInArrow(_emit_starts(least, REACH, run_chars), "doc_id long, h1 long, h2 long, s int, e int")
    # one shuffle of the windows; a group beyond memory is spilled
    w = Window.partitionBy("h1", "h2")
    met = windows.withColumn("first_doc", F.min("doc_id").over(w)).withColumn("_last", F.max("doc_id").over(w))
    return met.filter("first_doc < _last").select("doc_id", "s", "e", "first_doc")


def sharing(documents: DataFrame, doc_id: str, spans: DataFrame, least: int = 400, text: str = "text") -> DataFrame:
    """How much of each record stands in others, too.

    ``doc_id, n_bytes, shared_bytes, removable_bytes``: bytes of the text, of its
    stretches of at least ``least`` characters that stand unchanged in another
    record, and of the windows in them whose first record is another one, which
    deduplication would remove.  ``spans`` are the repeated runs, of
    all records or of those found.  Exact to the character at both ends.  Records
    without shared stretches have zeros.
    """
    spans = verified(documents, doc_id, spans, least, text)

    def add(seen, size: str):
        # windows in order: what reaches beyond those before
        w = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        to = F.coalesce(F.max(F.when(seen, F.col("e"))).over(w), F.lit(0))
        return F.when(seen, F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), to))).otherwise(0).alias(size)

    every = add(F.lit(True), "shared_bytes")
    later = add(F.col("first_doc") < F.col("doc_id"), "removable_bytes")
    cover = spans.select("doc_id", every, later).groupBy(F.col("doc_id").alias("_d")).agg(F.sum("shared_bytes").alias("shared_bytes"), F.sum("removable_bytes").alias("removable_bytes"))
    n = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(text).alias("n_bytes")).filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    out = n.join(cover, F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("shared_bytes", F.lit(0)).cast("long").alias("shared_bytes"), F.coalesce("removable_bytes", F.lit(0)).cast("long").alias("removable_bytes"))


def _strip_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ranges = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept, gone = [], []
        for t, spans in zip(texts, ranges, strict=True):
            if t is None or not spans:
                kept.append(t)
                gone.append(0)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(raw)), len(raw)]
            begin, end = np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans])
            out, n = [], 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = raw[a:b]
                x, y = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
                i = int(np.searchsorted(begin, x, "right")) - 1
                if x < y and i >= 0 and y <= end[i]:
                    n += 1
                else:
                    out.append(part)
            kept.append(b"".join(out).decode("utf-8", "surrogatepass"))
            gone.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(gone, pa.int32())], names=["doc_id", "text", "n_removed"])


_SENTENCE_END = re.compile(rb"\n(?!\n)|[.!?](?=[ \n\r\t])")


def without_repeats(documents: DataFrame, doc_id: str, spans: DataFrame, least: int = 400, text: str = "text") -> DataFrame:
    """``doc_id, text, n_removed``: every record without the sentences that lie in
    a shared stretch whose first record is another one.

    The first record of a stretch, the one with the least id, keeps it, so every
    passage stays once.  A sentence ends at a line break or at ``.``, ``!`` or
    ``?`` before a blank and goes only if all of it lies in stretches to be
    removed.  A null text stays null, other records come back as they are; rows
    repeat if the input's do; null ids are left out.
    """
    later = verified(documents, doc_id, spans, least, text).filter("first_doc < doc_id").select("doc_id", "s", "e").distinct()
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    fresh = F.coalesce(F.col("s") > F.col("_to"), F.lit(True))
    island = later.withColumn("_to", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_k", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # disjoint stretches of one record, each of at least ``least`` characters of its own text
    merged = island.groupBy("doc_id", "_k").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ranges"))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    met = docs.join(maybe_broadcast(checkpoint(merged)), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "text", "ranges")
    return met.mapInArrow(_strip_sentences, "doc_id long, text string, n_removed int")
