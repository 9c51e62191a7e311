"""Joins of traces with dimensions, evidence, other runs and gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import cut_lineage

#: A dimension is sent to all tasks only below this measured number of rows, and of bytes of their values as text.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast, if the table is measured to be small; else the planner chooses."""
    first = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("size"))
    n, total = first.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def compare(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """A full outer join on a null-safe key: both values, and on which side a key is."""
    o, n = old.select(*[F.col(k).alias(f"_o{k}") for k in key], F.col(value).alias("old"), F.lit(True).alias("_in_old")), new.select(*[F.col(k).alias(f"_n{k}") for k in key], F.col(value).alias("new"), F.lit(True).alias("_in_new"))
    on = None
    for k in key:
        same = F.col(f"_o{k}").eqNullSafe(F.col(f"_n{k}"))
        on = same if on is None else on & same
    side = F.when(F.col("_in_old").isNull(), "only_new").when(F.col("_in_new").isNull(), "only_old").otherwise("both")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"_o{k}", f"_n{k}").alias(k) for k in key], "old", "new", side.alias("side"))


def strict_compare(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """As compare, but an error if a key is repeated or on one side only. Each table is made once, in files, as it is read for the tests and for the result."""
    old, new = (cut_lineage(df.select(*key, value)) for df in (old, new))
    for name, df in (("old", old), ("new", new)):
        if not df.groupBy(*key).agg(F.count("*").alias("_times")).where("_times > 1").isEmpty():
            raise ValueError(f"repeated keys in the {name} table")
    both = compare(old, new, key, value)
    if not both.where("side <> 'both'").isEmpty():
        raise ValueError("the tables have different keys")
    return both.drop("side")


def paired(runs: DataFrame, key: list[str], arm: str, value: str, arms: tuple[str, str], order: list[str] | None = None) -> DataFrame:
    """One row a key with the values of both arms; keys without both are left out. Of repeated runs the last in `order` counts; without an order they are averaged."""

    def of(x: str):
        own = F.col(arm) == x
        if order is None:
            return F.avg(F.when(own, F.col(value)))
        return F.max_by(F.when(own, F.col(value)), F.when(own, F.struct(*order)))

    return runs.groupBy(*key).agg(*[of(x).alias(x) for x in arms]).where(F.col(arms[0]).isNotNull() & F.col(arms[1]).isNotNull())


def made_before(reads: DataFrame, made: DataFrame, by: str, order: str, name: str, variable: str) -> DataFrame:
    """Adds made_by to rows that read a name: the place of the last row of the same group before it that made it, or null.

    Both sides are put in one order by (group, name), in which the last maker so far is carried on: a sort and no list, however often a name is made.
    """
    key = lambda c: [F.col(by).alias("_by"), F.col(c).alias("_name"), F.col(order).alias("_at")]
    rows = reads.select(*key(name), F.lit(1).alias("_read"), F.lit(None).cast(made.schema[order].dataType).alias("_made"), F.struct(*reads.columns).alias("_row"))
    makers = made.select(*key(variable), F.lit(0).alias("_read"), F.col(order).alias("_made"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    # of one place the reads come first, as what is made there is not before them
    so_far = W.partitionBy("_by", "_name").orderBy("_at", F.desc("_read")).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.when(F.col("_name").isNotNull() & F.col("_by").isNotNull(), F.last("_made", ignorenulls=True).over(so_far))
    return rows.union(makers).withColumn("made_by", last).where("_read = 1").select("_row.*", "made_by")


def leave_self_out(cells: DataFrame, name: str) -> DataFrame:
    """exists: of the other cells of the submitter with this name, one that did not fail says true, else one that failed says false; null: none did.

    An earlier cell of the same trace that wrote it counts as true, too.
    """
    # counts of a group are an aggregate with partial sums, so no task holds a hot submitter's cells
    total = cells.groupBy(F.col("submitter").alias("_s"), F.col(name).alias("_n")).agg(F.count_if(~F.col("failed")).alias("_fine"), F.count_if(F.col("failed")).alias("_bad"))
    both = cells.join(small(total), cells["submitter"].eqNullSafe(total["_s"]) & cells[name].eqNullSafe(total["_n"]))
    fine, bad = F.col("_fine") - (~F.col("failed")).cast("long"), F.col("_bad") - F.col("failed").cast("long")
    return both.withColumn("exists", F.when(fine > 0, True).when(bad > 0, False)).drop("_s", "_n", "_fine", "_bad")


def kth_with_kth(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of a key with the k-th row of it on the other side."""
    lk = left.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*left_order)))
    rk = right.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*right_order)))
    return lk.join(rk, [key, "k"])


def ends(path) -> Column:
    """All ends of a path that begin at a part: of a/b/c.csv these are itself, b/c.csv and c.csv."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("substring_index", path, F.lit("/"), -i))


def suffix_pairs(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Paths that are equal, or one of which ends in / and the other.

    Each path gives a row for each of its ends, as many as it has parts, and the ends are
    joined with whole paths: paths of one base name meet only where they match. Different paths are matched, and rows joined back.
    """

    def matched(longer: DataFrame, at: str, shorter: DataFrame, other: str) -> DataFrame:
        known = shorter.select(F.col(other).alias("_short")).distinct()
        return longer.select(F.col(at).alias("_long")).distinct().select("_long", F.explode(ends(F.col("_long"))).alias("_short")).join(known, "_short")

    one = matched(left, left_path, right, right_path).select(F.col("_long").alias("_l"), F.col("_short").alias("_r"))
    two = matched(right, right_path, left, left_path).select(F.col("_short").alias("_l"), F.col("_long").alias("_r"))
    both = one.union(two).distinct()
    return left.join(both, left[left_path] == both["_l"]).join(right, F.col("_r") == right[right_path]).drop("_l", "_r")


def jobs_not_done(tasks: DataFrame, arms: list[str], seeds: int, done: DataFrame, key: str) -> DataFrame:
    """Tasks x arms x seeds without those done. The two factors are lists of the caller, so rows are multiplied by a constant."""
    jobs = tasks.select(key, F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")).select(key, "arm", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    return jobs.join(done, [key, "arm", "seed"], "left_anti")


def elsewhere(names: DataFrame, name: str = "name", source: str = "source") -> DataFrame:
    """For each (source, name): the other sources that have the name."""
    every = names.groupBy(name).agg(F.array_sort(F.collect_set(source)).alias("_all"))
    return names.select(source, name).distinct().join(every, name).select(source, name, F.array_remove("_all", F.col(source)).alias("found_in"))


def found_elsewhere(names: DataFrame, name: str = "name", source: str = "source") -> DataFrame:
    """For each (source, name): how many other sources have the name, one of them (the smallest, for that itself the greatest) and a class: here only, one other, several others.

    A name gives one row of counts, so a name that all sources have costs no more than another.
    """
    own = names.select(source, name).distinct()
    every = own.groupBy(name).agg(F.count("*").alias("_n"), F.min(source).alias("_low"), F.max(source).alias("_high"))
    others = F.col("_n") - 1
    another = F.when(F.col(source).eqNullSafe(F.col("_low")), F.when(others > 0, F.col("_high"))).otherwise(F.col("_low"))
    kind = F.when(others == 0, "here only").when(others == 1, "one other").otherwise("several others")
    both = own.alias("a").join(every.alias("b"), F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")))
    return both.select(source, F.col(f"a.{name}").alias(name), others.alias("others"), another.alias("another"), kind.alias("class"))


def not_in_domain(literals: DataFrame, domain: DataFrame, on: list[str]) -> DataFrame:
    return literals.join(domain.select(*on).distinct(), on, "left_anti")


def zipped(left: DataFrame, right: DataFrame, line: str = "line") -> DataFrame:
    """Two files row by row, by their line numbers."""
    return left.join(right, line)


def numbered_rows(rows: DataFrame, order: list[str], out: str, parts: int = 64) -> DataFrame:
    """Numbers from 1 in order, without one task for all rows.

    Rows are dealt by ranges of the order, those that agree in all of it by their
    place in the table, so that no value is too hot. Each range is numbered as it is
    sorted, and the sizes of the ranges before it, one row a range, are added.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    ranged = cut_lineage(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = F.broadcast(starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return ranged.join(starts, part == F.col("_part")).withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_start")
