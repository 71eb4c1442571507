"""Evaluation texts leaking into training text.

Items and documents are reduced to their words, in lower case, one blank
between them.  The character q-grams of the items form a small index that every
task holds; documents stream past it.  Hits are counted per document, item and
overlapping diagonal band; by the q-gram lemma a passage with at most ``edits``
errors leaves a known number of hits in one band, so only bands that reach it
are looked at again, by an alignment confined to the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 16  # characters of a gram: a power of two, for hashing by doubling
BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(r"\W+")


def normal(text: str) -> str:
    """The words of a text in lower case, with a blank around each."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the gram at every position, by doubling its length."""
    h, n, b = codes.astype(np.uint64), 1, BASE
    with np.errstate(over="ignore"):
        while n < q and len(h) > n:
            h = h[:-n] * b + h[n:]
            b, n = b * b, n * 2
        if n < q:
            return np.zeros(0, np.uint64)
        return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters from every position on, for any ``n``."""
    h, b, have = codes.astype(np.uint64), BASE, 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & have:
                # what is done so far, then the next part
                out = h if out is None else out[: len(h) - done] * b + h[done:] if len(h) > done else h[:0]
                done += have
            if have * 2 > n:
                return out ^ (out >> np.uint64(31))
            h = h[:-have] * b + h[have:] if len(h) > have else h[:0]
            b, have = b * b, have * 2


class Item:
    """Windows of ``words`` consecutive words of an item (or all it has): where
    they begin and end, and how many edits each may have."""

    def __init__(self, key: int, text: str, words: int, edits: int):
        self.key, self.text = key, normal(text)
        blanks = np.flatnonzero(_codes(self.text) == 32)
        tokens = len(blanks) - 1 if len(self.text) > 2 else 0
        k = min(words, tokens)
        # a window holds the blanks around it, so an exact match ends at word borders
        begin, end = (blanks[: tokens - k + 1], blanks[k : tokens + 1] + 1) if tokens else (blanks[:0], blanks[:0])
        # the lemma needs a positive bound: a short window allows fewer errors
        most = np.clip((end - begin - Q) // Q, 0, edits)
        self.windows = np.stack([begin, end, most], axis=1).astype(np.int32)
        self.bound = max(1, int((end - begin - Q + 1 - Q * most).min(initial=len(self.text))))
        self.short = tokens > 0 and int((end - begin).min()) < Q


class Index:
    def __init__(self, items: list[tuple[int, str]], words: int, edits: int):
        self.items = [Item(k, t, words, edits) for k, t in items]
        self.items = [i for i in self.items if len(i.windows)]
        # items shorter than a gram have no q-grams: they are looked for by hashes of their own length
        short = [n for n, i in enumerate(self.items) if i.short]
        self.tiny = {size: self._sorted([(n, window_hashes(_codes(self.items[n].text), size)) for n in short if len(self.items[n].text) == size]) for size in {len(self.items[n].text) for n in short}}
        self.hash, self.owner, self.place = self._sorted([(n, gram_hashes(_codes(i.text))) for n, i in enumerate(self.items)])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.width = edits + 1
        self.bounds = np.array([i.bound for i in self.items], np.int64)
        self.reach = max((len(i.text) for i in self.items), default=0) + 2 * self.width + Q

    @staticmethod
    def _sorted(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, whose they are and where they begin."""
        h = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(x), n, np.int32) for n, x in parts]) if parts else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for _, x in parts]) if parts else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        return h[order], owner[order], place[order]


def banded_edits(window: str, text: str, at: int, width: int, most: int) -> tuple[int, int] | None:
    """Fewest edits (at most ``most``) that turn ``window`` into a stretch of
    ``text`` beginning within ``width`` of ``at``, and where it begins."""
    for s in range(max(0, at - width), min(len(text), at + width) + 1):
        if text.startswith(window, s):
            return 0, s
    if not most:
        return None
    best: tuple[int, int] | None = None
    for s in range(max(0, at - width), min(len(text), at + width) + 1):
        if s and text[s - 1] != " " and text[s : s + 1] != " ":
            continue
        region = text[s : s + len(window) + most]
        row = {j: j for j in range(min(most, len(region)) + 1)}
        for i, c in enumerate(window, 1):
            nxt: dict[int, int] = {}
            for j in range(max(0, i - most), min(len(region), i + most) + 1):
                d = min(row.get(j, most + 1) + 1, nxt.get(j - 1, most + 1) + 1)
                if j:
                    d = min(d, row.get(j - 1, most + 1) + (region[j - 1] != c))
                nxt[j] = d
            row = nxt
            if min(row.values(), default=most + 1) > most:
                break
        else:
            d = min(row.values())
            if d <= most and (best is None or d < best[0]):
                best = (d, s)
    return best


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """``(text number, item key, edits, position)`` of the leaks in normal texts,
    the one with fewest edits per text and item."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    codes = _codes("".join(texts))
    starts = np.cumsum([0, *map(len, texts)])
    h = gram_hashes(codes)
    at = np.flatnonzero(index.seen[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(index.hash, h[at], "left"), np.searchsorted(index.hash, h[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    doc = np.searchsorted(starts, at, "right") - 1
    inside = at + Q <= starts[doc + 1]
    at, lo, n, doc = at[inside], lo[inside], n[inside], doc[inside]
    if len(at):
        each = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, place = index.owner[each].astype(np.int64), index.place[each].astype(np.int64)
        pos, doc = np.repeat(at - starts[doc], n), np.repeat(doc, n)
        diagonal = pos - place
        band = diagonal // index.width
        # every hit counts in two overlapping bands, so a passage that drifts by up to ``edits`` stays in one
        keys = np.concatenate([np.stack([doc, item, band]), np.stack([doc, item, band - 1])], axis=1)
        cells, counts = np.unique(keys, axis=1, return_counts=True)
        enough = counts >= index.bounds[cells[1]]
        for d, i, b in cells[:, enough].T.tolist():
            it, text = index.items[i], texts[d]
            key = (d, it.key)
            if found.get(key, (9, 0))[0] == 0:
                continue
            for s, e, most in it.windows.tolist():
                got = banded_edits(it.text[s:e], text, b * index.width + s + index.width, 2 * index.width, most)
                if got and (key not in found or got[0] < found[key][0]):
                    found[key] = got
                    if got[0] == 0:
                        break
    for size, (hashes, owners, _) in index.tiny.items():
        h = window_hashes(codes, size)
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for at in np.flatnonzero(hi > lo).tolist():
            d = int(np.searchsorted(starts, at, "right")) - 1
            where = at - int(starts[d])
            for n in owners[lo[at] : hi[at]].tolist():
                it = index.items[n]
                if (d, it.key) not in found and texts[d].startswith(it.text, where):
                    found[(d, it.key)] = (0, where)
    return [(d, k, e, p) for (d, k), (e, p) in found.items()]


def _pieces(text: str, most: int, overlap: int) -> Iterator[tuple[int, str]]:
    """A normal text in overlapping pieces of bounded length."""
    at = 0
    while True:
        yield at, text[at : at + most]
        if at + most >= len(text):
            return
        at += most - overlap


def _scan(index, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple[int, int, int, int]] = []
            texts: list[str] = []
            owner: list[tuple[int, int]] = []
            held = 0

            def flush() -> None:
                got = search(ix, texts)
                rows.extend((owner[d][0], k, e, owner[d][1] + p) for d, k, e, p in got)

            for n, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                for at, piece in _pieces(normal(text), max(chars, 2 * ix.reach), ix.reach):
                    texts.append(piece)
                    owner.append((n, at))
                    held += len(piece)
                    if held >= chars:
                        flush()
                        texts, owner, held = [], [], 0
            if texts:
                flush()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64())))],
                names=["doc_id", "item_id", "edits", "position"],
            )

    return run


def leaks(
    documents: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    words: int = 13,
    edits: int = 2,
    block_chars: int = 4_000_000,
    task_chars: int = 1_000_000,
) -> DataFrame:
    """``doc_id, item_id, edits, position``: documents that hold ``words``
    consecutive words of an item (all of them if it has fewer), up to ``edits``
    character errors; ``position`` is where in the document's normal form.

    Only words count: runs of letters, digits and underscores, without regard to
    case.  A window shorter than ``(edits + 1)`` grams allows fewer errors, so
    that the lemma keeps a bound; other windows of its item don't.  The items are
    a query set: they are indexed in blocks of about ``block_chars`` characters
    (some 50 bytes each while it is built), every one held by every task, and the documents are
    scanned once per block, so neither side is ever shuffled.
    Null and empty texts and items without words match nothing; repeated rows
    give repeated results; extra columns are ignored.
    """
    q = items.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).filter("k is not null and t is not null").dropDuplicates(["k", "t"])
    total = q.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = documents.sparkSession
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r["k"], r["t"]) for r in part.collect()], words, edits))
        got = docs.mapInArrow(_scan(index, task_chars), "doc_id long, item_id long, edits int, position long")
        out = got if out is None else out.unionByName(got)
    # a document cut into pieces can show the same leak twice
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "position")).alias("_m")).select("doc_id", "item_id", "_m.edits", "_m.position")
