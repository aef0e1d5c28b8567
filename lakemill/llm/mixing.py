"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents stand in a shuffled but repeatable order (the MD5 of seed
and doc_id). A document's virtual finish time is its source's cumulative size divided by the
source's target; a second pass over a source goes on counting, so its time is later by size /
target. All finish times are ranged in one global order, and the mix takes documents until the total
budget is spent. As targets are the shares at which every queue ends at time 1, each source ends
within a document of its target.

Running sums never put one source into one task. The order key is uniform within a source, so
fixed ranges of it (buckets) hold a bounded number of rows whatever the source's share; sums of
buckets, a small table, give each bucket its base. The global truncation does the same over ranges
of finish time. All of it is DataFrame operations.

Cases: a null or empty text has size 0 and is never taken; a null source is a source, the last;
rows with equal order keys follow doc_id, then size; repeated rows count each; an empty table gives no rows; extra
columns are kept by ``mix`` and ignored by ``plan``. A null doc_id is shuffled by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096  # of the shuffled order; of a source of 3 billion documents one holds 0.8 million
SPANS = 1 << 16  # of finish time, for each unit of it; 10 billion documents in the mix put about 0.15 million into one


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, cap: int = 2) -> DataFrame:
    """The target of each source from its total size: a row for each source, so small.

    Weights repeat over the sources in order of code points, null last. Sharing stops at cap times
    a source's size and the excess goes to the others by weight: with sources in order of size / weight, the first
    k stop at their cap, and the rest share what is left, for the least k at which that is below the next one's cap.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = ranked.withColumn("weight", w).withColumn("limit", F.col("source_size") * cap)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("rank"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(whole) * budget_percent)
    )
    level = (F.col("budget") - F.col("stopped") * 100) / (F.col("left") * 100)
    rows = rows.withColumn("level", F.when(level <= F.col("limit") / F.col("weight"), level))
    rows = rows.withColumn("level", F.max("level").over(whole))
    shared = F.col("level") * F.col("weight")
    return rows.select("source", "source_size", "weight", F.when(shared < F.col("limit"), shared).otherwise(F.col("limit").cast("double")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, cap: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs."""
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"), F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")).alias("key"))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    rows = common.materialize(rows, "mix")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_percent, cap)
    # where each range of the shuffled order begins within its source
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).select("source", "bucket", F.coalesce(F.sum("in_bucket").over(up), F.lit(0)).alias("base"))
    bases = bases.alias("b").join(by_source.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target")
    bases = bases.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "source_size", "target")
    here = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left").drop("b_source", "b_bucket")
    queued = queued.withColumn("upto", F.col("base") + F.sum("size").over(here))
    for k in range(cap):
        queued = queued.withColumn(f"finish_{k}", F.when(F.col("size") > 0, (F.col("upto") + k * F.col("source_size")) / F.col("target")))
    queued = common.materialize(queued.drop("bucket", "base", "upto"), "mix")
    # global order: sums over ranges of finish time find the range in which the budget ends
    budget = (rows.agg(F.sum("size").alias("n")).first()["n"] or 0) * budget_percent // 100
    span = lambda c: F.least(F.floor(c * SPANS), F.lit(SPANS * 16)).cast("int")
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), F.col(f"finish_{k}").alias("finish")) for k in range(cap)])).alias("turn")
    turns = queued.where("size > 0").select("key", "doc_id", "source", "size", stack).select("key", "doc_id", "source", "size", "turn.pass", "turn.finish")
    ranges = turns.groupBy(span(F.col("finish")).alias("span")).agg(F.sum("size").alias("n"))
    ranges = ranges.select("span", F.sum("n").over(Window.orderBy("span")).alias("upto"), "n")
    edge = ranges.where(F.col("upto") > budget).agg(F.min(F.struct("span", "upto", "n")).alias("e")).select("e.*").first()
    if edge is None or edge["span"] is None:
        last_span, inside = None, None
    else:
        last_span = edge["span"]
        room = budget - (edge["upto"] - edge["n"])
        line = Window.partitionBy("span").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "pass").rowsBetween(Window.unboundedPreceding, 0)
        at_edge = turns.withColumn("span", span(F.col("finish"))).where(F.col("span") == last_span)
        inside = at_edge.withColumn("run", F.sum("size").over(line)).where(F.col("run") <= room)
        inside = inside.agg(F.max(F.struct("finish", F.col("source").isNull().alias("none"), "source", "key", "doc_id", "size", "pass")).alias("m")).first()["m"]
    copies = F.lit(0)
    for k in range(cap):
        finish = F.col(f"finish_{k}")
        if last_span is None:
            ok = finish.isNotNull()
        else:
            ok = span(finish) < last_span
            if inside is not None:
                mine = F.struct(finish, F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.lit(k))
                last = F.struct(F.lit(inside["finish"]), F.lit(inside["none"]), F.lit(inside["source"]).cast("string"), F.lit(inside["key"]), F.lit(inside["doc_id"]).cast("long"), F.lit(inside["size"]).cast("long"), F.lit(inside["pass"]))
                ok = ok | ((span(finish) == last_span) & (mine <= last))
        copies = copies + F.when(ok, 1).otherwise(0)
    out = queued.withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "key")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed rows themselves, a row for each copy taken, with docs' columns.

    Rows that agree in doc_id, source and size are one row to the plan; their copies are dealt evenly.
    """
    i, s, z, copies, same, n, own, each = common.unused(docs, "id", "of", "size", "copies", "same", "words", "own", "each")
    chosen = plan(docs, weights, budget_percent, cap, seed)
    chosen = chosen.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z)).agg(F.sum("copies").alias(copies), F.count("*").alias(same)).where(F.col(copies) > 0)
    rows = docs.withColumn(n, size_of(F.col("text").cast("string")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(n) == F.col(z))
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", n).orderBy("text"))
    joined = rows.join(chosen, on, "inner").withColumn(own, F.floor(F.col(copies) / F.col(same)) + F.when(turn <= F.col(copies) % F.col(same), 1).otherwise(0))
    return joined.where(F.col(own) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
