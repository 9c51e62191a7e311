"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks of `block_rows`. In the ideal stream every source
advances all the time at the rate of its weight, and when one has no blocks
left its rate goes to the others in proportion. A block is released in the slot
in which the ideal stream begins it, and due in that in which it is ended; each
slot takes, of the released blocks, the one due earliest. On one stream this
earliest-deadline-first order meets every deadline, so that after any number of
slots each source is less than one block from the ideal stream.

Every source has a schedule of its own and its weight as given, without rounding.
The order of the blocks is made on the driver, which holds the names and counts
of the sources and eight bytes a block: it follows from what went before, slot by
slot. `block_rows` sets what that is for a table. No row is dropped or repeated.

Defined cases: a null source is a source of its own; where weights are given, each
source without one has the least positive weight given; weights of sources
without rows are ignored; weights must not be negative, and sources of weight 0
come after all others, with equal shares; with no weights given they are the
square roots of the row counts. Ties are broken by source name. Rows of a source
are taken in an order set by a hash of the id; repeated rows stay; ids may be null
or of any kind that sorts; texts are not read; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, fresh, numbered

BLOCK_ROWS, CHUNK = 16, 4096


def _windows(blocks: dict[str, int], weights: dict[str, float]):
    """A function that gives the slots in which the ideal stream begins and ends block i of source s."""
    ends = sorted((n / weights[s], n, weights[s]) for s, n in blocks.items())
    at = [e[0] for e in ends]
    done = [0, *accumulate(e[1] for e in ends)]
    rates = [*accumulate((e[2] for e in reversed(ends)), initial=0.0)][::-1]  # of the sources left after each end

    def slots(s: str, i: int) -> float:
        v = i / weights[s]
        k = bisect_left(at, v)
        x = done[k] + rates[k] * v
        near = round(x)
        return near if abs(x - near) < 1e-6 else x  # sums of floats that stand for whole slots

    return lambda s, i: (math.floor(slots(s, i)), math.ceil(slots(s, i + 1)))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source, by earliest deadline first."""
    out, t = {s: array("q") for s, n in blocks.items() if n}, 0
    for own in ({s: weights[s] for s in out if weights[s] > 0}, {s: 1.0 for s in out if not weights[s] > 0}):
        window = _windows({s: blocks[s] for s in own}, own)
        first, ready = t, []
        waiting = [(0, s, window(s, 0)[1]) for s in sorted(own)]
        heapq.heapify(waiting)
        while waiting or ready:
            while waiting and (waiting[0][0] <= t - first or not ready):
                _, s, due = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s))
            _, s = heapq.heappop(ready)
            out[s].append(t)
            t += 1
            if (i := len(out[s])) < blocks[s]:
                released, due = window(s, i)
                heapq.heappush(waiting, (released, s, due))
    return out


def mix(rows: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block, slot and place (in the block) of every row: the mixed order is by slot, then place."""
    spark = rows.sparkSession
    named = rows.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_s")).withColumn("_h", F.xxhash64("doc_id", F.lit(3)))
    n = {r["_s"]: r["n"] for r in named.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # a row a source
    if weights is None:
        own = {s: math.sqrt(k) for s, k in n.items()}
    else:
        if min(weights.values(), default=0) < 0:
            raise ValueError("weights must not be negative")
        given = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        least = min((w for s, w in given.items() if s in n and w > 0), default=1.0)
        own = {s: given.get(s, least) for s in n}
    slots = schedule({s: math.ceil(k / block_rows) for s, k in n.items()}, own)
    plan = spark.createDataFrame([(s, i // CHUNK, at[i : i + CHUNK].tolist()) for s, at in slots.items() for i in range(0, len(at), CHUNK)], "_p string, _c long, slots array<long>")
    ranked = numbered(named, "_s", ["_h", "doc_id"], "_r").withColumn("block", F.floor(F.col("_r") / block_rows))
    # A row of the plan has the slots of CHUNK blocks, so a large source is many keys.
    placed = ranked.withColumn("_k", F.floor(F.col("block") / CHUNK)).join(plan, (F.col("_s") == F.col("_p")) & (F.col("_k") == F.col("_c")))
    slot = F.get("slots", (F.col("block") % CHUNK).cast("int"))
    return placed.select("doc_id", "source", "block", slot.alias("slot"), (F.col("_r") % block_rows).alias("place"))


def in_mixed_order(docs: DataFrame, key, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows with all their columns, dealt to partitions by ranges of the mixed order and sorted: files read in turn are the mixed stream.

    `key` is a column that names a row.
    """
    name, at = fresh(docs, "key"), fresh(docs, "at")
    keyed = docs.withColumn(name, key)
    order = checkpoint(mix(keyed.select(F.col(name).alias("doc_id"), "source"), weights).groupBy(F.col("doc_id").alias(name)).agg(F.min(F.struct("slot", "place")).alias(at)))
    total = (order.agg(F.max(f"{at}.slot")).first()[0] or 0) + 1
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each slot has a block, so equal ranges of slots are equal parts of the rows: no sample has to find their borders
    part = F.floor(F.col(f"{at}.slot") * n / total).cast("int")
    return keyed.join(order, name).repartitionById(n, part).sortWithinPartitions(at).select(*docs.columns)
