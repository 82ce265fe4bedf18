"""Near-duplicates by Order MinHash over five-word k-mers, verified by banded alignment of the words.

A sketch of a text takes the ``order`` k-mers with the smallest hashes, each labelled with its occurrence number, and
keeps them in text order; texts with one equal sketch are candidates. Links are pairs of different texts whose word
edit similarity (1 - distance / longer length) is ``similarity`` or more; classes are their connected components.

Candidates are met without emitting all pairs of a group. Each text is aligned with one smallest member of its buckets, the
one that it shares most of them with, then with those of its other buckets as far as they are in another component by then;
that puts most buckets into one component. A bucket that still holds several components is open: a small one
compares its members across components; the members of large ones (texts that share a passage) are compared whole: all
that large open buckets join, stand in different components and have fitting lengths meet in salted blocks, where the words
they share rule most pairs out before any alignment. Nothing is dropped there; the cost grows with the square of the texts of
like length in such a family.
Texts of up to ``short`` words also meet by their rarest words, an exact way that leaves no pair of theirs out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import banded_distance, edit_limit
from .common import Scratch, free_names, plain_words, slices


@dataclass(frozen=True)
class NearDupParams:
    """``sketches`` sketches of ``order`` k-mers of ``k`` words; open buckets over ``bucket`` members are compared in blocks."""

    k: int = 5
    order: int = 2
    sketches: int = 56
    similarity: float = 0.8
    bucket: int = 16
    seed: int = 97
    #: Texts of up to so many words have exact candidate keys beside the sketches.
    short: int = 30
    #: Texts of up to ``dense_words`` words have ``dense`` sketches: theirs hold fewer unbroken k-mers at the same similarity.
    dense: int = 96
    dense_words: int = 75

    def sketches_of(self, words: int) -> int:
        return max(self.dense, self.sketches) if words <= self.dense_words else self.sketches


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Elements of the matrix of sketch hashes held at once.
_CELLS = 1 << 21
#: A block of texts compared with another one: so many words at most, and so many texts.
_BLOCK_WORDS, _BLOCK_TEXTS = 1 << 20, 2048
#: A pair that meets by a rare word costs as much as so many that are counted all together.
_DENSE = 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers of word hashes, each with its occurrence number mixed in; a shorter text is one k-mer."""
    n = len(words)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        at = np.arange(len(s))
        first = np.maximum.accumulate(np.where(same, 0, at))
        # A first occurrence keeps its hash, so texts with and without repeats agree in it.
        h[order] = np.where(at > first, _mix(s + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s)
    return h


def order_sketches(h: np.ndarray, p: NearDupParams, count: int | None = None) -> np.ndarray:
    """One 64-bit key per sketch (``count`` of them): its smallest labelled k-mers, in text order, folded together with the sketch's number."""
    rng = np.random.default_rng(p.seed)
    count, most = count or p.sketches, max(p.dense, p.sketches)
    mul = rng.integers(1, 1 << 63, most, dtype=np.uint64)[:count] * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, most, dtype=np.uint64)[:count]
    keys = np.zeros(count, np.uint64)
    take = min(p.order, len(h))
    step = max(1, _CELLS // len(h))
    for at in range(0, count, step):
        m, a = mul[at : at + step, None], add[at : at + step, None]
        v = h[None, :] * m + a
        v ^= v >> np.uint64(29)
        rows = np.arange(len(v))
        places = np.empty((len(v), take), np.int64)
        for t in range(take):
            places[:, t] = v.argmin(axis=1)
            v[rows, places[:, t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places.sort(axis=1)
        key = np.arange(at, at + len(v), dtype=np.uint64)
        for t in range(take):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[places[:, t]])
        keys[at : at + step] = key
    return keys


def _sketch_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [plain_words(t) if t is not None else [] for t in batch.column(2).to_pylist()]
            sizes = [len(x) for x in lists]
            hashes = pd.util.hash_array(np.array(list(itertools.chain.from_iterable(lists)), dtype=object), categorize=True) if sum(sizes) else np.zeros(0, np.uint64)
            ends = np.cumsum(sizes)
            keys = [order_sketches(kmer_hashes(hashes[e - n : e], p.k), p, p.sketches_of(n)).view(np.int64) if n else None for n, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_words", "keys"])

    return run


def digest_of(column: str = "text"):
    """128 bits that stand for an equal text."""
    return F.unhex(F.md5(F.col(column)))


def _verify_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            split: dict[str, list[str]] = {}
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = (split[t] if t in split else split.setdefault(t, plain_words(t)) for t in (x, y))
                keep.append(banded_distance(a, b, edit_limit(max(len(a), len(b)), p.similarity)) is not None)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, words): the hashes of each text's words, in order."""
    for batch in slices(batches):
        lists = [plain_words(t) for t in batch.column(1).to_pylist()]
        flat = pd.util.hash_array(np.array(list(itertools.chain.from_iterable(lists)), dtype=object), categorize=True).view(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[e - len(x) : e] for x, e in zip(lists, ends)], pa.list_(pa.int64()))], names=["rid", "words"])


def prefix_size(n: int, similarity: float) -> int:
    """Of a text of ``n`` words, how many of its rarest words must hold one that any text within the edit limit has among its own."""
    return edit_limit(n, similarity) + 1


def _prefix_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, words = batch.column(2).to_pylist(), batch.column(3)
            bags = [sorted(zip(c, w)) for c, w in zip(batch.column(1).to_pylist(), words.to_pylist())]
            keys = [[w for _, w in bag[: prefix_size(n, p.similarity)]] for n, bag in zip(sizes, bags)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["rid", "n_words", "keys"])

    return run


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, word): every occurrence of a word once, hashed with its number."""
    for batch in slices(batches):
        bags = [kmer_hashes(w.values.to_numpy(zero_copy_only=False).view(np.uint64), 1).view(np.int64) for w in batch.column(1)]
        rids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(b) for b in bags])
        flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(flat, pa.int64())], names=["rid", "word"])


def shared_words(bags: list[np.ndarray], first: slice, second: slice) -> np.ndarray:
    """How many words each text of ``first`` shares with each of ``second``; bags hold every occurrence once."""
    sizes = [len(b) for b in bags]
    names, ids, held = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    texts = np.repeat(np.arange(len(bags)), sizes)
    rank = np.cumsum(held > 1) - 1
    often = held[ids] > 1
    ids, texts = rank[ids[often]], texts[often]
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], texts[order]
    out = np.zeros((first.stop - first.start, second.stop - second.start), np.float32)
    width = 4096
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, [at, at + width])
        cells = np.zeros((len(bags), width), np.float32)
        cells[texts[lo:hi], ids[lo:hi] - at] = 1
        out += cells[first] @ cells[second].T
    return out


def rare_meetings(bags: list[np.ndarray], split: int, similarity: float, most: int) -> np.ndarray | None:
    """Pairs (first, second) of texts that meet by a word among their rarest, as many as the edit limit and one; None if words give over ``most`` pairs.

    In any common order of words no pair within the limit is missed (prefix filter); here it is the order of how many texts hold them.
    """
    sizes = np.array([len(b) for b in bags])
    _, ids, held = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    texts = np.repeat(np.arange(len(bags)), sizes)
    order = np.lexsort((ids, held[ids], texts))
    ids = ids[order]
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = (place < np.repeat([prefix_size(int(n), similarity) for n in sizes], sizes)) & (held[ids] > 1)
    ids, texts = ids[rare], texts[rare]
    order = np.argsort(ids, kind="stable")  # texts of a word stay in order
    ids, texts = ids[order], texts[order]
    # Each text meets those after it in its word, from the second block only if there are two.
    stop = np.searchsorted(ids, ids, "right")
    begin = np.arange(len(ids)) + 1
    if split:
        second = np.cumsum(np.concatenate([[0], texts < split]))
        first_of = np.searchsorted(ids, ids, "left")
        begin = first_of + second[stop] - second[first_of]
        begin[texts >= split] = stop[texts >= split]
    times = stop - begin
    total = int(times.sum())
    if total > most:
        return None
    at = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(total)
    pairs = np.unique(np.repeat(texts, times) * len(bags) + texts[at])
    return np.stack([pairs // len(bags), pairs % len(bags)], axis=1)


def block_links(rids: list[int], labels: list[int], words: list[np.ndarray], split: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join all components which links between texts before ``split`` and texts from it on join; within one block if it is 0.

    A pair within the edit limit shares all words of the longer text but as many as the limit. Pairs of one component
    are not aligned again.
    """
    first, second = (slice(0, split), slice(split, len(rids))) if split else (slice(0, len(rids)), slice(0, len(rids)))
    if min(labels) == max(labels):
        return []
    sizes = np.array([len(w) for w in words])
    bags = [kmer_hashes(w.view(np.uint64), 1) for w in words]
    same = np.array(labels)
    met = rare_meetings(bags, split, similarity, (first.stop - first.start) * (second.stop - second.start) // _DENSE)
    if met is not None:
        a, b = met[same[met[:, 0]] != same[met[:, 1]]].T
        longer = np.maximum(sizes[a], sizes[b])
        needed = longer - np.floor((1 - similarity) * longer + 1e-9)
        fits = np.minimum(sizes[a], sizes[b]) >= needed
        pairs = ((i, j) for i, j, n in zip(a[fits].tolist(), b[fits].tolist(), needed[fits].tolist()) if len(np.intersect1d(bags[i], bags[j], assume_unique=True)) >= n)
    else:
        # Rare words rule too little out: all shared words are counted.
        longer = np.maximum(sizes[first, None], sizes[None, second])
        limit = np.floor((1 - similarity) * longer + 1e-9)
        ok = (shared_words(bags, first, second) >= longer - limit) & (same[first, None] != same[None, second])
        if not split:
            ok = np.triu(ok, 1)
        pairs = ((i, j + second.start) for i, j in zip(*(x.tolist() for x in np.nonzero(ok))))
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, lists = [], {}
    for i, j in pairs:
        a, b = root(labels[i]), root(labels[j])
        if a == b:
            continue
        x, y = (lists[t] if t in lists else lists.setdefault(t, words[t].tolist()) for t in (i, j))
        if banded_distance(x, y, edit_limit(max(len(x), len(y)), similarity)) is not None:
            parent[max(a, b)] = min(a, b)
            out.append((rids[i], rids[j]))
    return out


def _block_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            # One row is one pair of blocks: its texts, those of the first block before those of the second.
            texts = batch.column(0)[0].values
            side = texts.field("side").to_numpy(zero_copy_only=False)
            order = np.argsort(side, kind="stable")
            rids, labels, words = texts.field("rid").to_pylist(), texts.field("label").to_pylist(), texts.field("words")
            mixed = side.min() != side.max()
            if batch.column(1)[0].as_py() and not mixed:
                continue
            split = int((side == 0).sum()) if mixed else 0
            found = block_links([rids[t] for t in order], [labels[t] for t in order], [words[int(t)].values.to_numpy(zero_copy_only=False) for t in order], split, p.similarity)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _ratio_ok(a: str, b: str, similarity: float):
    """What the lengths alone allow: the longer text differs by its surplus at least."""
    longer, shorter = F.greatest(a, b), F.least(a, b)
    return longer - shorter <= F.floor(longer * (1 - similarity) + 1e-9)


class _Run:
    """One run of the operator: its tables in the shared folder. Texts go by ``rid``, a number given to each different text."""

    def __init__(self, spark: SparkSession, p: NearDupParams):
        self.spark, self.p, self.tables = spark, p, Scratch(spark, "neardup")

    def verified(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose texts align. A hub a meets its text first, while the rows are narrow."""
        first = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
        return self.tables.save(both.mapInArrow(_verify_batches(self.p), "a long, b long"), name)

    def components(self, edges: DataFrame) -> DataFrame:
        """(rid, label): the smallest rid of its component, for every text with a link.

        Each round hangs every text on its smallest neighbour before it, follows these to their tops (``forest``) and makes
        each tree one point. Only links between different points go on, each once, so they grow few in few rounds and no
        round reads all links again.
        """
        links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        links = self.tables.save(links, "edges")
        ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).distinct()
        done = self.tables.save(ends.select("rid", F.col("rid").alias("label")), "labels")
        while not links.isEmpty():
            tops = self.forest(links.groupBy("b").agg(F.min("a").alias("a")))
            moved = tops.select(F.col("rid").alias("label"), F.col("label").alias("to"))
            after = self.tables.save(done.join(moved, "label", "left").select("rid", F.coalesce("to", "label").alias("label")), "labels")
            known = lambda side: tops.select(F.col("rid").alias(side), F.col("label").alias(f"l{side}"))  # noqa: B023, E731
            named = links.join(known("a"), "a", "left").select("b", F.coalesce("la", "a").alias("la")).distinct()
            named = named.join(known("b"), "b", "left").select("la", F.coalesce("lb", "b").alias("lb")).filter("la <> lb")
            fewer = self.tables.save(named.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
            self.tables.drop(links, done)
            links, done = fewer, after
        self.tables.drop(links)
        return done.select("rid", "label")

    def forest(self, links: DataFrame) -> DataFrame:
        """(rid, label) of links (a, b) in which every b stands once and after its a: each text takes its label's label until none changes."""
        tops = links.select(F.col("a").alias("rid")).distinct().join(links.select(F.col("b").alias("rid")), "rid", "left_anti")
        labels = self.tables.save(links.select(F.col("b").alias("rid"), F.col("a").alias("label")).unionByName(tops.select("rid", F.col("rid").alias("label"))), "labels")
        while True:
            up = labels.select(F.col("rid").alias("label"), F.col("label").alias("above"))
            after = self.tables.save(labels.join(up, "label").select("rid", F.col("label").alias("was"), F.col("above").alias("label")), "labels")
            changed = not after.filter("was <> label").isEmpty()
            self.tables.drop(labels)
            labels = after
            if not changed:
                return labels.select("rid", "label")

    def joined(self, labels: DataFrame, found: DataFrame) -> DataFrame:
        """Labels after further links: only those between different components are followed, each component as one point."""
        known = lambda side: labels.select(F.col("rid").alias(side), F.col("label").alias(f"l{side}"))
        named = found.join(known("a"), "a", "left").join(known("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
        bridges = self.tables.save(named.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "bridges")
        if bridges.isEmpty():
            return labels
        moved = self.components(bridges).select(F.col("rid").alias("label"), F.col("label").alias("to"))
        fresh = found.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(labels, "rid", "left_anti").select("rid", F.col("rid").alias("label"))
        out = labels.unionByName(fresh).join(moved, "label", "left").select("rid", F.coalesce("to", "label").alias("label"))
        return self.tables.save(out, "joined").select("rid", "label")

    def members(self, keyed: DataFrame, name: str) -> DataFrame:
        """Rows of buckets with two texts or more, with the bucket's size and its smallest text."""
        sizes = keyed.groupBy("key").agg(F.count("*").alias("held"), F.min("rid").alias("hub"), F.min_by("n_words", "rid").alias("hub_words")).filter("held > 1")
        return self.tables.save(keyed.join(sizes, "key"), name)

    def star(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of each member b and its bucket's smallest text a, as far as lengths fit, and the ``keys`` they share so."""
        fits = _ratio_ok("n_words", "hub_words", self.p.similarity)
        pairs = members.filter("rid <> hub").where(fits).groupBy(F.col("hub").alias("a"), F.col("rid").alias("b")).agg(F.count("*").alias("keys"))
        return self.tables.save(pairs, "star")

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (a, b) that do not stand in one component."""
        known = lambda side: labels.select(F.col("rid").alias(side), F.col("label").alias(f"l{side}"))
        named = pairs.select("a", "b").join(known("b"), "b", "left").join(known("a"), "a", "left")
        return named.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    def open_buckets(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, with their component."""
        named = members.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        still = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        return named.join(still, "key")

    def across(self, rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's members that stand in different components and have fitting lengths."""
        x = rows.select("key", F.col("rid").alias("a"), F.col("n_words").alias("na"), F.col("label").alias("la"))
        y = rows.select("key", F.col("rid").alias("b"), F.col("n_words").alias("nb"), F.col("label").alias("lb"))
        fits = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _ratio_ok("na", "nb", self.p.similarity)
        return x.join(y, "key").where(fits).select("a", "b").distinct()

    def compared(self, groups: DataFrame, worded: DataFrame, name: str) -> DataFrame:
        """Links (a, b) between the members of every group of ``groups`` (key, rid, n_words, label), as far as they join components.

        A group is dealt into blocks by a hash of rid, and each two blocks meet in a row of their own.
        """
        sizes = groups.groupBy("key").agg(F.count("*").alias("held"), F.max("n_words").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        block = F.greatest(F.lit(8), F.least(F.lit(_BLOCK_TEXTS), F.floor(F.lit(_BLOCK_WORDS) / F.col("most")).cast("int")))
        n = F.ceil(F.col("held") / block).cast("int")
        mine = groups.join(sizes.select("key", n.alias("n")), "key").withColumn("at", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
        dealt = mine.select("key", "rid", "label", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "rid", "label", (F.col("at") > F.col("other")).cast("int").alias("side"))
        rows = dealt.join(worded, "rid").groupBy("key", "i", "j").agg(F.collect_list(F.struct("rid", "label", "side", "words")).alias("texts"))
        return self.tables.save(rows.select("texts", (F.col("i") < F.col("j")).alias("two")).mapInArrow(_block_batches(self.p), "a long, b long"), name)

    def short_groups(self, short: DataFrame, worded: DataFrame) -> DataFrame:
        """(key, rid, n_words): the rarest words of each short text, as many as the edit limit and one.

        Texts within the limit share all words of the longer one but as many as the limit, so in any common order of
        words their first ones meet (prefix filter); nothing within the limit is lost. Each word's key stands for itself.
        """
        words = self.tables.save(worded.mapInArrow(_bag_batches, "rid long, word long"), "short-words")
        counts = words.groupBy("word").agg(F.count("*").alias("texts"))
        bags = words.join(counts, "word").groupBy("rid").agg(F.collect_list(F.struct("texts", "word")).alias("bag"))
        rows = bags.join(short, "rid").select("rid", F.col("bag.texts").alias("counts"), "n_words", F.col("bag.word").alias("words"))
        return rows.mapInArrow(_prefix_batches(self.p), "rid long, n_words int, keys array<long>").select(F.explode("keys").alias("key"), "rid", "n_words")

    def classes(self, docs: DataFrame) -> DataFrame:
        """(digest, doc_id, label) of every different text that has a word; equal labels are one class."""
        p, tables = self.p, self.tables
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"), F.col("text").cast("string").alias("text"))
        sketched = rows.mapInArrow(_sketch_batches(p), "doc_id long, digest binary, n_words int, keys array<long>")
        one = tables.save(sketched.filter("n_words > 0").dropDuplicates(["digest"]).withColumn("rid", F.monotonically_increasing_id()), "texts-once")
        keyed = one.select("rid", "n_words", F.posexplode("keys").alias("idx", "key"))
        members = self.members(keyed, "members")
        brief = one.filter(F.col("n_words") <= int(p.short / p.similarity)).select("rid", "n_words")
        wanted = members.select("rid").unionByName(brief.select("rid")).distinct().join(one.select("rid", "doc_id", "digest"), "rid")
        # A text with many copies is fetched from the row that stands for it, so equal texts do not meet in one task.
        found = rows.join(wanted.withColumnRenamed("doc_id", "its_id"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (rows["digest"] == wanted["digest"]))
        texts = tables.save(found.select("rid", "text").dropDuplicates(["rid"]), "texts")

        # The text that shares most keys comes first; what is in one component by then is not aligned again.
        star = self.star(members)
        nearest = tables.save(star.groupBy("b").agg(F.max(F.struct("keys", (-F.col("a")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("a"), "b"), "nearest")
        labels = self.forest(self.verified(nearest, texts, "links"))
        others = tables.save(self.apart(star, labels).join(nearest, ["a", "b"], "left_anti"), "others")
        labels = self.joined(labels, self.verified(others, texts, "more-links"))
        rest = tables.save(self.open_buckets(members.drop("hub_words"), labels), "open")
        small = tables.save(self.across(rest.filter(F.col("held") <= p.bucket)).join(star, ["a", "b"], "left_anti"), "pairs")
        if not small.isEmpty():
            labels = self.joined(labels, self.verified(small, texts, "small-links"))
        wide = rest.filter(F.col("held") > p.bucket)
        if not wide.isEmpty():
            # Texts that large open buckets join, one by another, are a family: only its members meet, and in fitting lengths.
            family = self.components(wide.filter("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()).withColumnRenamed("label", "family")
            large = wide.select("rid", "n_words").distinct()
            worded = tables.save(texts.join(large.select("rid"), "rid").mapInArrow(_word_batches, "rid long, words array<long>"), "words")
            # Each text stands in its band of lengths and the next, so any two whose lengths fit share one.
            band = F.floor(F.log("n_words") / F.log(F.lit(1 / p.similarity)) + 1e-9).cast("long")
            named = large.join(family, "rid").join(labels, "rid", "left")
            banded = named.select(F.explode(F.array(band, band + 1)).alias("band"), "family", "rid", "n_words", F.coalesce("label", "rid").alias("label"))
            banded = banded.select(F.xxhash64("family", "band").alias("key"), "rid", "n_words", "label")
            labels = self.joined(labels, self.compared(banded, worded, "block-links"))
        # Short texts seldom share a sketch of unbroken k-mers; a short one meets all whose lengths fit by their rarest words.
        if not brief.isEmpty():
            worded = tables.save(texts.join(brief.select("rid"), "rid").mapInArrow(_word_batches, "rid long, words array<long>"), "short-texts")
            keyed = tables.save(self.short_groups(brief, worded), "short-keys")
            labelled = keyed.join(labels, "rid", "left").select("key", "rid", "n_words", F.coalesce("label", "rid").alias("label"))
            labels = self.joined(labels, self.compared(labelled, worded, "short-links"))
        tables.drop(texts, members)
        return one.select("digest", "doc_id", "rid").join(labels, "rid", "left").select("digest", "doc_id", F.coalesce("label", "rid").alias("label"))


def near_duplicate_classes(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class) and class_size.

    Equal texts are one text from the start; near copies are linked as the module says. Null texts are each a class of
    their own; all empty texts are equal, and texts without a word are only ever equal to others, never near them. Of
    rows that repeat a doc_id each counts. A class whose doc_ids are all null has a null class_id. Other columns of
    ``docs`` are not read; an empty table gives no rows. Long texts are sketched and aligned whole.
    """
    run = _Run(docs.sparkSession, params)
    classes = run.classes(docs).select("digest", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"))
    named = rows.join(classes, "digest", "left")
    # Texts without a word have no label: their digest is their class; a null text has neither.
    group = F.struct(F.col("label"), F.when(F.col("label").isNull(), F.col("digest")).alias("alone"))
    live = named.filter(F.col("digest").isNotNull()).select("doc_id", group.alias("group"))
    sizes = live.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = live.join(sizes, live["group"].eqNullSafe(sizes["group"])).select("doc_id", "class_id", "class_size")
    alone = named.filter(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def keep_one_per_class(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """The documents with one row kept of each class, that of the smallest doc_id; all columns stay as they are.

    Rows with null texts all stay. Null doc_ids come last. Of rows equal in doc_id and text one stays.
    """
    run = _Run(docs.sparkSession, params)
    classes = run.classes(docs).select("digest", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest")).filter("digest is not null")
    group = F.struct(F.col("label"), F.when(F.col("label").isNull(), F.col("digest")).alias("alone"))
    first = rows.join(classes, "digest", "left").groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    chosen = run.tables.save(first.select(F.col("first.doc_id").alias("its_id"), F.col("first.digest").alias("its_digest")), "chosen")
    digest, key = free_names(docs, "digest", "key")
    src = docs.withColumn(digest, digest_of()).withColumn(key, F.col("doc_id").cast("long"))
    kept = src.join(chosen, F.col(key).eqNullSafe(chosen["its_id"]) & (F.col(digest) == chosen["its_digest"]), "left_semi")
    kept = kept.dropDuplicates([key, digest]).drop(key, digest)
    return kept.unionByName(docs.filter(F.col("text").isNull()))
