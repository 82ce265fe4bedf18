"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Bits of the uniform number drawn from a row's hash.
UNIFORM_BITS = 52
#: The largest mean of one draw; a larger one is the sum of several.
MOST_AT_ONCE = 500


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the keys: 52 of its bits, put in the middle of their step."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, UNIFORM_BITS // 4), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << UNIFORM_BITS)


def poisson_steps(mean: float) -> list[float]:
    """The cumulative probabilities of 0, 1, 2 ... up to 1 as far as a double goes."""
    if not 0 <= mean <= MOST_AT_ONCE:
        raise ValueError(f"the mean of one draw is from 0 to {MOST_AT_ONCE}")
    p = math.exp(-mean)
    steps, total, k = [], p, 0
    while True:
        steps.append(total)
        k += 1
        p *= mean / k
        if k > mean and total + p == total:
            return steps
        total += p


def poisson_count(u: Column, mean: float) -> Column:
    """The smallest k whose cumulative probability is over ``u``: a constant table, searched by comparison."""
    return F.aggregate(F.array(*[F.lit(x) for x in poisson_steps(mean)]), F.lit(0), lambda n, x: n + (u >= x).cast("int"))


def poisson_draw(seed: int, key: Column, mean: float) -> Column:
    """A Poisson count of any mean for a key: up to ``MOST_AT_ONCE`` from one uniform number, else the sum of equal draws, each with its own number."""
    if not 0 <= mean < math.inf:
        raise ValueError("a mean repetition rate is a number from 0 on")
    parts = math.ceil(mean / MOST_AT_ONCE)
    if parts <= 1:
        return poisson_count(uniform(seed, key), mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda n, part: n + poisson_count(uniform(seed, key, part), mean / parts))


def mean_rates(docs: DataFrame, weights: dict[str, float], *, rows: int | None = None) -> dict[str, float]:
    """Copies per document and source: the source's share of ``rows`` (as many as there are, by default) over its rows.

    Every source that ``weights`` names takes part; rows of others (null too) are one further source that the key ``*``
    names, or have the mean 0 where it is missing. The driver receives one number for each named weight.
    """
    named = [w for w in weights if w != "*"]
    label = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit("*"))
    counts = {r["label"]: r["n"] for r in docs.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}
    total = rows if rows is not None else sum(counts.values())
    live = {s: w for s, w in weights.items() if counts.get(s)}
    scale = sum(live.values())
    return {s: w / scale * total / counts[s] for s, w in live.items()} if scale else {}


def mix(docs: DataFrame, weights: dict[str, float], *, seed: int = 7, rows: int | None = None, rates: dict[str, float] | None = None, named: tuple[str, str] = ("copy", "n_copies")) -> DataFrame:
    """Repeat each document by a Poisson count and shuffle all copies.

    The count inverts the Poisson distribution of the source's mean rate at a number hashed from seed and doc_id (over
    a mean of ``MOST_AT_ONCE``, it is the sum of several such draws, so a rare source may have any rate); the same
    document always gets the same count, and rows that repeat a doc_id get the same one (so do all null ids).
    Columns of ``docs`` stay and two come on, ``named``: the copy's number (0 up) and the count; a column of either name is replaced.
    A document with count 0 has no row: that is the method's way to weigh a source down. Rows of a source that
    ``weights`` lacks count under ``*``. An empty table gives no rows. Copies are dealt out by a seeded hash of doc_id, copy
    and position and sorted by another within each task, which neither a large source nor a repeated document can skew.
    """
    rates = mean_rates(docs, weights, rows=rows) if rates is None else rates
    count = F.lit(0)
    if "*" in rates:
        count = poisson_draw(seed, F.col("doc_id"), rates["*"])
    chain = None
    for source, mean in rates.items():
        if source != "*":
            hit, drawn = F.col("source") == F.lit(source), poisson_draw(seed, F.col("doc_id"), mean)
            chain = chain.when(hit, drawn) if chain is not None else F.when(hit, drawn)
    if chain is not None:
        unnamed = ~F.coalesce(F.col("source").isin([s for s in weights if s != "*"]), F.lit(False))
        chain = chain.when(unnamed, count).otherwise(F.lit(0))
    number, total = named
    names = [c for c in docs.columns if c.lower() not in (number.lower(), total.lower())]
    plain = [F.col(f"`{c}`") for c in names]
    counted = docs.select(*plain, (chain if chain is not None else count).alias(total)).filter(F.col(total) > 0)
    copies = counted.withColumn(number, F.explode(F.sequence(F.lit(0), F.col(total) - 1)))
    (place,) = free_names(copies, "place")
    placed = copies.withColumn(place, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(number), F.monotonically_increasing_id()))
    return placed.repartition(F.col(place)).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), place)).select(*plain, number, total)
