"""Benchmark decontamination: windows of the items' sizes, embedded by a CGK random walk, met by bit-sampling LSH, verified by edit distance.

The walk reads a string of word ids and writes, at each of its steps, the id under its head; a random bit of the step and
the id tells whether the head moves on. Two strings of small edit distance get walks of small Hamming distance, so keys
made of sampled steps meet with a known chance, and repetitions bring the recall to the target.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import banded_distance, edit_limit
from .common import SLICE_ROWS, plain_words, slices


@dataclass(frozen=True)
class DecontamParams:
    """``repeats`` keys of ``bits`` sampled steps for each random walk of an item; ``walks`` tells how many walks that are.

    Items whose lengths differ by less than ``band`` share their sampled steps, which lie in the first ``reach`` steps for
    each word of the shortest, ``most_steps`` at most. Items under ``exact_words`` words have no walks: their unbroken parts
    are looked up. Items under ``min_words`` words are left out. ``block_bytes`` bounds the items that one pass over the
    documents holds; a larger benchmark takes several passes with the same result. ``cells`` bounds what is embedded at once.
    """

    similarity: float = 0.8
    min_words: int = 1
    exact_words: int = 8
    repeats: int = 12
    bits: int = 3
    band: float = 1.25
    reach: float = 1.0
    most_steps: int = 120
    seed: int = 41
    block_bytes: int = 8 << 20
    cells: int = 1 << 17

    def walks(self, words: int) -> int:
        """Measured so that 0.95 and more of the windows at the similarity limit meet, and more below it."""
        return 8 if words <= 32 else 12 if words <= 64 else 16


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TABLE_BITS = 22


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def cgk_walk(strings: np.ndarray, steps: int, seed: int, walk: int) -> np.ndarray:
    """The first ``steps`` symbols of the walks over strings of word ids, one string per row; 0 after a string's end.

    At each step the head reads a symbol and moves on where the coin of this step and symbol says so.
    """
    width = strings.shape[1]
    flat = np.ascontiguousarray(np.concatenate([strings, np.zeros((len(strings), 1), strings.dtype)], axis=1)).reshape(-1)
    head = np.arange(len(strings), dtype=np.int64) * (width + 1)
    end = head + width
    out = np.empty((steps, len(strings)), np.uint64)
    for step in range(steps):
        symbol = flat[head].astype(np.uint64)
        out[step] = symbol
        coin = (symbol * _A + np.uint64(((seed * 64 + walk) * 65536 + step) * 0x9E37 & 0xFFFFFFFFFFFF)) * _B
        head = np.minimum(head + (coin >> np.uint64(63)).astype(np.int64), end)
    return out


class ItemIndex:
    """The benchmark items of one block, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], p: DecontamParams):
        self.p = p
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.pairs = np.zeros(1 << _TABLE_BITS, bool)
        for item_id, text in items:
            words = plain_words(text or "")
            if len(words) < p.min_words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.items.append((item_id, ids))
            a = np.array(ids, np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True
        self.items.sort(key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[1]))
        self.longest = len(self.items[-1][1]) if self.items else 0
        #: Of each word, its place among those of the item in hand; -1 for all others.
        self.places = np.full(len(self.vocabulary) + 1, -1, np.int64)
        at = 0
        #: Length of a part -> (its sorted hashes, the item and the part's place in it for each).
        self.parts: dict[int, tuple[np.ndarray, list[tuple[int, int]]]] = {}
        found: dict[int, list] = {}
        while at < len(self.items) and len(self.items[at][1]) < p.exact_words:
            for offset, part in self._split(self.items[at][1]):
                found.setdefault(len(part), []).append((int(self._run(np.array(part, np.int64), len(part))[0]), at, offset))
            at += 1
        for size, rows in found.items():
            rows.sort()
            self.parts[size] = (np.array([h for h, _, _ in rows], np.uint64), [(k, o) for _, k, o in rows])
        self.bands = []
        while at < len(self.items):
            low = len(self.items[at][1])
            stop = at
            while stop < len(self.items) and len(self.items[stop][1]) < max(low + 1, low * p.band):
                stop += 1
            self.bands.append(self._band(at, stop))
            at = stop

    def _split(self, ids: list[int]) -> list[tuple[int, list[int]]]:
        """The item in one part more than it may have edits: one part at least stands unbroken in any window within the limit."""
        n = edit_limit(len(ids), self.p.similarity) + 1
        cuts = [len(ids) * k // n for k in range(n + 1)]
        return [(a, ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _run(ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of every run of ``size`` ids."""
        h = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            h = _mix(h * _A + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1))
        return h

    def _band(self, at: int, stop: int) -> dict:
        """Items ``at`` to ``stop``: their key table, the pairs a window must hold, and the sampled steps."""
        p = self.p
        sizes = [len(ids) for _, ids in self.items[at:stop]]
        steps = max(p.bits, min(int(p.reach * sizes[0]), p.most_steps))
        walks = p.walks(sizes[-1])
        rng = np.random.default_rng([p.seed, sizes[0]])
        picked = [[np.sort(rng.choice(steps, p.bits, replace=False)) for _ in range(p.repeats)] for _ in range(walks)]
        # A walk of so many steps reads no more words than it has steps.
        strings = np.zeros((stop - at, steps), np.int64)
        for k, (_, ids) in enumerate(self.items[at:stop]):
            strings[k, : len(ids[:steps])] = ids[:steps]
        keys = self._keys([cgk_walk(strings, steps, p.seed, w) for w in range(walks)], picked).reshape(-1)
        order = np.argsort(keys, kind="stable")
        owners = np.tile(np.arange(at, stop), walks * p.repeats)
        # Whether any key has these first bits; most found ones have none and need no search.
        shift = np.uint64(64 - min(22, max(16, len(keys).bit_length() + 5)))
        held = np.zeros(1 << (64 - int(shift)), bool)
        held[(keys >> shift).astype(np.int64)] = True
        return {"keys": keys[order], "owners": owners[order], "shift": shift, "held": held, "picked": picked, "steps": steps, "walks": walks, "most": max(sizes), "needed": min(n - 1 - 2 * edit_limit(n, p.similarity) for n in sizes)}

    @staticmethod
    def _keys(walks: list[np.ndarray], picked) -> np.ndarray:
        """One key per repetition (rows) and string (columns): the symbols at the sampled steps, folded together."""
        rows = []
        for walk, sets in zip(walks, picked):
            for steps in sets:
                key = np.full(walk.shape[1], len(rows) + 1, np.uint64)
                for step in steps:
                    key = (key ^ (key >> np.uint64(31)) ^ walk[step]) * _A
                rows.append(_mix(key))
        return np.stack(rows)

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mix(a.astype(np.uint64) * _A + b.astype(np.uint64)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    @property
    def rows(self) -> int:
        """Texts searched at once: each has a gap as long as the longest item."""
        return max(1, min(SLICE_ROWS, (8 * self.p.cells) // max(1, self.longest)))

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text, item -> (distance, first word, words of the window, words of the item) of its best window.

        A window within an item's edit limit keeps all but twice the limit of its word pairs, so windows with fewer
        pairs of the items are passed over without loss. The others are embedded, and what shares a key is aligned. The
        texts stand in one array with a gap of unknown words after each, so that windows may hang over a text's end.
        """
        best: list[dict] = [{} for _ in texts]
        if not self.items:
            return best
        get = self.vocabulary.get
        gap = [0] * self.longest
        flat: list[int] = []
        begins = []
        for text in texts:
            begins.append(len(flat))
            flat.extend(map(get, plain_words(text), repeat(0)) if text else ())
            flat += gap
        begin = np.array(begins)
        ids = np.array(flat + gap, np.int64)
        pair = np.zeros(len(ids), bool)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pair[at] = self.pairs[self._slot(ids[at], ids[at + 1])]
        last = len(flat)
        total = np.zeros(last + self.longest + 1, np.int32)
        np.cumsum(pair[:last], out=total[1 : last + 1])
        total[last + 1 :] = total[last]
        self._look_up(ids, begin, best)
        for band in self.bands:
            most = band["most"] - 1
            starts = np.flatnonzero(total[most : most + last] - total[:last] >= band["needed"])
            rows = max(1, self.p.cells // band["steps"])
            for chunk in range(0, len(starts), rows):
                part = starts[chunk : chunk + rows]
                strings = ids[part[:, None] + np.arange(band["steps"])]
                walks = [cgk_walk(strings, band["steps"], self.p.seed, w) for w in range(band["walks"])]
                self._meet(band, self._keys(walks, band["picked"]), part, ids, begin, best)
        return best

    def _look_up(self, ids: np.ndarray, begin: np.ndarray, best: list[dict]) -> None:
        """Short items, by the parts of theirs that stand in the texts unbroken."""
        met = set()
        for size, (keys, places) in self.parts.items():
            found = self._run(ids, size)
            lo = np.searchsorted(keys, found, "left")
            for at in np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == found).tolist():
                for k in range(lo[at], np.searchsorted(keys, found[at], "right")):
                    owner, offset = places[k]
                    shift = edit_limit(len(self.items[owner][1]), self.p.similarity)
                    met.update((owner, at - offset + d) for d in range(-shift, shift + 1) if at - offset + d >= 0)
        for owner, start in sorted(met):
            self._verify(owner, start, ids, begin, best)

    def _meet(self, band: dict, found: np.ndarray, starts: np.ndarray, ids: np.ndarray, begin: np.ndarray, best: list[dict]) -> None:
        flat = found.reshape(-1)
        hit = np.flatnonzero(band["held"][(flat >> band["shift"]).astype(np.int64)])
        lo, hi = (np.searchsorted(band["keys"], flat[hit], side) for side in ("left", "right"))
        times = hi - lo
        first = np.repeat(lo - np.cumsum(times) + times, times)
        owners = band["owners"][first + np.arange(len(first))]
        met = np.unique(owners * len(starts) + np.repeat(hit % len(starts), times))
        at = 0
        while at < len(met):
            owner = int(met[at] // len(starts))
            stop = int(np.searchsorted(met, (owner + 1) * len(starts)))
            for start in self._fitting(owner, starts[met[at:stop] % len(starts)], ids).tolist():
                self._verify(owner, start, ids, begin, best)
            at = stop

    def _fitting(self, owner: int, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The starts whose windows share so many words with the item, each as often as both have it, as any window within its edit limit does."""
        names, counts = np.unique(self.items[owner][1], return_counts=True)
        n, m = len(self.items[owner][1]), len(names)
        place = self.places
        place[names] = np.arange(m)
        out = []
        for at in range(0, len(starts), rows := max(1, self.p.cells // n)):
            part = starts[at : at + rows]
            cells = place[ids[part[:, None] + np.arange(n)]]
            row, _ = np.nonzero(cells >= 0)
            held = np.bincount(row * m + cells[cells >= 0], minlength=len(part) * m).reshape(-1, m)
            out.append(part[np.minimum(held, counts).sum(axis=1) >= n - edit_limit(n, self.p.similarity)])
        place[names] = -1
        return np.concatenate(out)

    def _verify(self, owner: int, start: int, ids: np.ndarray, begin: np.ndarray, best: list[dict]) -> None:
        """Align an item with the window of its size at ``start``; the best window of its text is kept."""
        item_id, words = self.items[owner]
        n = len(words)
        doc = int(np.searchsorted(begin, start, "right")) - 1
        held = best[doc].get(item_id)
        limit = edit_limit(n, self.p.similarity)
        stop = int(begin[doc + 1]) - self.longest if doc + 1 < len(begin) else len(ids) - 2 * self.longest
        window = ids[start : min(start + n, stop)].tolist()
        d = banded_distance(window, words, limit if held is None else min(limit, held[0]))
        if d is not None and (held is None or (d, start - int(begin[doc])) < held[:2]):
            best[doc][item_id] = (d, start - int(begin[doc]), len(window), n)


_INDEXES: dict = {}


def _hit_batches(handle, p: DecontamParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = handle.value[0]
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = ItemIndex(handle.value[1], p)
        index = _INDEXES[key]
        for batch in slices(batches, index.rows):
            rows = []
            for row, doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), index.search(batch.column(2).to_pylist())):
                for item_id, (d, start, n, size) in found.items():
                    rows.append((row, doc_id, item_id, start, n, d, 1 - d / size))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

    return run


HITS = "row long, doc_id long, item_id long, first_word int, n_words int, distance int, similarity double"


def _item_blocks(items: DataFrame, p: DecontamParams):
    """The items in blocks of bounded size, one after the other; what the driver holds is one block."""
    src = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = src.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / p.block_bytes))
    for block in range(blocks):
        part = src if blocks == 1 else src.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in part.distinct().toLocalIterator()]


def contamination_hits(docs: DataFrame, items: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """Passages of benchmark items in documents: one row per document row and item, with its best window.

    Columns: doc_id, item_id, first_word and n_words (the window, in words), distance (words inserted, deleted or
    replaced) and similarity (1 - distance / longer length), at least ``similarity``. Words are compared in lower case
    without punctuation. Items under ``min_words`` words, null and empty items match nothing; null and empty texts have no
    hits. Items that repeat an item_id with other texts each search, and the best window of all is given. Null
    doc_ids and item_ids stay null; rows of ``docs`` that repeat each have their hits. Whole texts are searched, however long; other
    columns are not read; an empty table on either side gives no rows. Documents are not shuffled: each block of items is sent
    to the workers whole, its size bounded. Only the hits of a benchmark of several blocks are, to find the best.
    """
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, blocks = None, 0
    for part in _item_blocks(items, params):
        handle = spark.sparkContext.broadcast((uuid.uuid4().hex, part))
        hits = src.mapInArrow(_hit_batches(handle, params), HITS)
        out, blocks = hits if out is None else out.unionByName(hits), blocks + 1
    if blocks > 1:
        best = F.min(F.struct("distance", "first_word", "n_words", "similarity")).alias("best")
        out = out.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.first_word", "best.n_words", "best.distance", "best.similarity")
    return out.select("doc_id", "item_id", "first_word", "n_words", "distance", "similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """The documents that hold no passage of an item, with all their columns.

    Null and empty texts stay, as do all rows where there are no items; rows that repeat are each judged alike.
    """
    at, spark = docs.columns.index("text"), docs.sparkSession
    out = docs
    for part in _item_blocks(items, params):
        handle = spark.sparkContext.broadcast((uuid.uuid4().hex, part))

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            key = handle.value[0]
            if key not in _INDEXES:
                _INDEXES.clear()
                _INDEXES[key] = ItemIndex(handle.value[1], params)
            for batch in slices(batches, _INDEXES[key].rows):
                clean = [not found for found in _INDEXES[key].search(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
