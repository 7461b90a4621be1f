"""Mixing sources to target weights by capped water-filling (operator 3).

Targets share out a total by weight; no source is asked for more than `max_epochs` times what it has, and what it can't give is shared
among the others by their weights until none is above its cap. A source that must give r times its size gives each document floor(r)
times, and once more the documents that come first in an order by seeded hash, up to the rest: so its words come within half a document
of the target, and reruns agree. The order is never sorted as a whole: hashes fall into buckets, bucket sums are aggregated before they
are shuffled, and only the one bucket of a source in which the rest runs out is ordered row by row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import free_names, materialize

#: Buckets of the order within a source.
BUCKETS = 4096
#: Rows of a sources' table that the driver takes; a mixture is a thing that people write down.
MAX_SOURCES = 1_000_000
#: The words of a text; fixed pattern of the size.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def water_fill(sizes: list[int], weights: list[int], total: Fraction, max_epochs: int) -> list[Fraction]:
    """Exact targets: shares of `total` by weight, each at most max_epochs * size; less in all only if every source is at its cap."""
    caps = [Fraction(max_epochs * s) for s in sizes]
    target = [Fraction(0)] * len(sizes)
    # sources reach their caps in the order of cap / weight
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (caps[i] / weights[i], i))
    left, weight = Fraction(total), sum(weights[i] for i in order)
    for k, i in enumerate(order):
        if caps[i] * weight <= left * weights[i]:
            target[i] = caps[i]
            left -= caps[i]
            weight -= weights[i]
        else:
            for j in order[k:]:
                target[j] = left * weights[j] / weight
            break
    return target


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), max_epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) and copies of every row; with `keep`, the columns of `docs` and that of copies, named `keep`.

    Sources in the order of their code points, null last, have the weights given, repeating. A null text has no words, and is taken as
    often as its place in the order says, like any text. Rows that repeat are drawn each for itself, and equal rows fall together in
    the order: they are apart by chance of no bucket, so they are ordered among themselves by a count. A table without words has
    targets of zero; an empty table gives no rows.
    """
    base = docs.select(
        (F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("int")).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    thin = materialize(base.drop("row"), "sizes") if not keep else base.drop("row")
    sums = materialize(thin.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "buckets")
    found = sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r.source, r.words) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    given = [weights[i % len(weights)] for i in range(len(found))]
    target = water_fill([w for _, w in found], given, Fraction(sum(w for _, w in found)) * share, max_epochs)
    rows = []
    for (source, words), t in zip(found, target):
        whole = int(t // words) if words else 0
        rows.append((source, words, float(t), whole, float(t - whole * words)))
    plan = docs.sparkSession.createDataFrame(rows, "plan_source string, source_size long, target double, whole int, rest double")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    # the bucket of each source in which the rest runs out, and the words before it
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    edge = before.where("before <= rest and before + words > rest").select("source", "bucket", "before")
    edge = materialize(edge.groupBy("source").agg(F.max("bucket").alias("edge"), F.max("before").alias("before")), "edges").withColumnRenamed("source", "edge_source")
    edge = F.broadcast(edge) if len(rows) <= 100_000 else edge
    source = base if keep else thin
    full = source.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    # a source whose rest is all of its words or nothing has no such bucket
    full = full.withColumn("extra", F.when(F.col("edge").isNull(), (F.col("rest") > 0).cast("int")).otherwise((F.col("bucket") < F.col("edge")).cast("int")))
    inner = full.where("not (bucket <=> edge)")
    order = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    border = full.where("bucket = edge").withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    border = border.withColumn("extra", (F.col("sofar") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("sofar")
    copies = (F.col("whole") + F.col("extra")).cast("int")
    both = inner.unionByName(border)
    if keep:
        return both.select(*[F.col("row")[c].alias(c) for c in docs.columns], copies.alias(keep))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its columns: each row as often as the mix takes it."""
    copies, copy = free_names(docs.columns, "copies", "copy")
    drawn = mix(docs, keep=copies, **options)
    each = drawn.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns])
