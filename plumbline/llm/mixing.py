"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks. With target weight w, block i (from 0) of a source is
released at slot floor(i / w) and due at slot ceil((i + 1) / w). Earliest deadline first over the
released blocks gives each slot one block, and no source is ever a whole block ahead of or behind
its weight. A source that has run out goes on with blocks without rows, so the slots of the others
never depend on it.

Weights are kept as exact fractions. After as many slots as their common denominator the schedule
repeats, so one period is scheduled, and each block takes its slot from the period's table by its
number modulo the source's part. A period longer than MOST_SLOTS is not made: the slots are walked
in order up to the last block that has rows. Both give the same slots. The schedule is made by one
task in a state of one number a source; sources, sizes and weights are tables, none is collected.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import fits_broadcast
from plumbline.session import Workspace

#: Documents of a block.
BLOCK = 64
#: Default weights are the sources' sizes to this power (above 0 and below 1 lifts small sources), in parts of PARTS.
POWER, PARTS = 0.5, 65_536
#: The longest period whose schedule is made once and repeated; where it is longer, all slots are walked.
MOST_SLOTS = 4_000_000
#: Given weights that are the floats nearest to fractions with denominators up to this are taken as those.
DENOMINATOR = 100_000
_NEW = ["mix_block", "mix_release", "mix_deadline", "mix_slot"]


def default_parts(sources: DataFrame, power: float = POWER) -> DataFrame:
    """``sources`` (n) with part: sizes to a power as whole numbers, about PARTS in all and 1 at least for each."""
    lifted = sources.withColumn("lift", F.pow(F.col("n").cast("double"), F.lit(power)))
    count, all_of = lifted.agg(F.count("*"), F.sum("lift")).first()
    unit = max(PARTS, 4 * count) / (all_of or 1.0)
    return lifted.withColumn("part", F.greatest(F.lit(1), F.round(F.col("lift") * unit)).cast("long").cast("string")).drop("lift")


def given_parts(sources: DataFrame, weights: dict[str | None, float]) -> DataFrame:
    """``sources`` (s) with part: the given weights as whole numbers; a source that they lack weighs as the least of them."""
    exact = exact_parts(weights)
    named = sources.sparkSession.createDataFrame([(s, str(p)) for s, p in exact.items()], "named string, part string")
    found = sources.join(named, F.col("s").eqNullSafe(F.col("named")), "left").drop("named")
    return found.withColumn("part", F.coalesce("part", F.lit(str(min(exact.values())))))


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers in exactly the given proportions (0.91 is 91 / 100)."""

    def exact(w: float) -> Fraction:
        near = Fraction(w).limit_denominator(DENOMINATOR)
        return near if near and float(near) == float(w) else Fraction(w)

    found = {s: exact(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in found.values()))
    parts = {s: int(x * unit) for s, x in found.items()}
    most = math.gcd(*parts.values())
    return {s: p // most for s, p in parts.items()}


def schedule(parts: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source's number, block, release, deadline, slot) of all blocks in the order of slots: earliest deadline first, ties by number.

    A source's weight is its part of the sum of all parts. After its last block a source's slots pass without one.
    """
    total, left = sum(parts), sum(blocks)
    done = [0] * len(parts)
    waiting = [(0, k) for k in range(len(parts))]
    ready: list[tuple[int, int]] = []
    slot = 0
    while left:
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // parts[k]), k))
        deadline, k = heapq.heappop(ready)  # the weights make up the whole, so some block is always released
        if done[k] < blocks[k]:
            yield k, done[k], done[k] * total // parts[k], deadline, slot
            left -= 1
        done[k] += 1
        slot += 1
        heapq.heappush(waiting, (done[k] * total // parts[k], k))


def _plan(block: int, again: bool):
    """The schedule of a table of sources (s, n, part) in one task, in the order of their names, null first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, blocks = [], [], []
        for batch in batches:
            names += batch.column("s").to_pylist()
            parts += map(int, batch.column("part").to_pylist())
            blocks += [-(-n // block) for n in batch.column("n").to_pylist()]
        for rows in batched(schedule(parts, parts if again else blocks), 10_000):
            source, *numbers = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in source], pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], ["s3", "turn", "release", "deadline", "slot"])

    return run


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, power: float = POWER) -> DataFrame:
    """The rows with their place in the mixture: all columns and mix_block, mix_release, mix_deadline, mix_slot.

    ``mix_slot`` orders the mixture; the rows of a slot are one block. While no source has run out,
    any source's share of the first n slots is within one block of its weight, however many slots
    there are. When a source has run out, its share of the slots stays empty, so every other block
    keeps its slot. No row is dropped or repeated.
    Without ``weights`` they are the sources' sizes to the power ``power``, as whole parts
    (``default_parts``); a source that ``weights`` lacks weighs as the least, and weights of sources
    without rows count for nothing. Weights are kept exactly.

    Blocks are cut in the order of the ids within a source (nulls first; repeated ids by all other
    columns' hash). Texts of any length pass unread. A null source is a source. An empty table gives
    no rows. Input columns named like the new ones are replaced.
    """
    if weights and any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    docs = docs.drop(*_NEW)
    # work names cannot clash: input columns travel in a struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("s"), F.col(f"`{id_col}`").cast("long").alias("k"))
    rows = rows.withColumns({"h": F.xxhash64("row"), "m": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("s"), F.asc_nulls_first("k"), F.asc("h"), F.asc("m")]
    # ranges of rows, not of ids: a hot source or id is many ranges
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranked = ws.save(ranked.select("row", "s", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranked")
    counts = ws.save(ranked.groupBy("s", "range").agg(F.count("*").alias("n"), F.min("at").alias("first")), "counts")
    sources = ws.save(counts.groupBy("s").agg(F.sum("n").alias("n")), "sizes")
    if sources.isEmpty():
        return spark.createDataFrame([], T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in _NEW]]))
    sources = ws.save(given_parts(sources, weights) if weights else default_parts(sources, power), "sources")
    # exact sum of parts of any length: the given ones are no more than the caller's weights
    total = sum(int(r.part) * r.k for r in sources.groupBy("part").agg(F.count("*").alias("k")).toLocalIterator())
    if total.bit_length() > 1_000 or sources.agg(F.max(F.ceil(F.col("n") / block).cast("double") / F.col("part").cast("double"))).first()[0] * total >= 2.0**62:
        raise ValueError("weights are too far from the sizes of the sources for slots of 64 bits")
    again = total <= MOST_SLOTS
    plan = sources.select("s", "n", "part").coalesce(1).sortWithinPartitions(F.asc_nulls_first("s"))
    plan = ws.save(plan.mapInArrow(_plan(block, again), "s3 string, turn long, release long, deadline long, slot long"), "plan")

    # a row's number in its source: rows of the source in the ranges before, and its place in the range
    before = F.sum("n").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("s").alias("s1"), F.col("range").alias("r1"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    ranked = ranked.join(ws.save(starts, "starts"), F.col("s").eqNullSafe(F.col("s1")) & (F.col("range") == F.col("r1")))
    ranked = ranked.withColumn("block", F.floor((F.col("shift") + F.col("at")) / block))
    if again:
        own = sources.select(F.col("s").alias("s2"), F.col("part").cast("long").alias("part"))
        own = F.broadcast(own) if fits_broadcast(own, own.count()) else own
        ranked = ranked.join(own, F.col("s").eqNullSafe(F.col("s2")))
        ranked = ranked.withColumn("round", F.floor(F.col("block") / F.col("part")) * total).withColumn("own", F.col("block") % F.col("part"))
    else:
        ranked = ranked.withColumn("round", F.lit(0)).withColumn("own", F.col("block"))
    ranked = ranked.join(plan, F.col("s").eqNullSafe(F.col("s3")) & (F.col("own") == F.col("turn")))
    at = lambda c: (F.col(c) + F.col("round")).cast("long").alias(f"mix_{c}")
    return ranked.select("row.*", F.col("block").cast("long").alias("mix_block"), at("release"), at("deadline"), at("slot"))
