"""Rules over whole data sets in one scan: what may run with bounded memory, and the aggregates that run it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.functions.storage import free_names, materialize
from verdictframe.operators.compiler import Compiler
from verdictframe.plans.ir import CollectionPredicate, Comparison, DatasetRef, Expression, Not, PolicySet, Refusal, Rule

LOCAL, AGGREGATE, GLOBAL = 0, 1, 2
DEFAULT_ROW_BUDGET = DEFAULT_CAP = 10_000_000


@dataclass(frozen=True)
class DatasetSpec:
    """A named data set and what its rows are."""

    id: str
    format: str
    kind: str = "row"
    requires_global_index: bool = False

    @property
    def digest(self) -> str:
        text = "|".join((self.id, self.format, self.kind, "true" if self.requires_global_index else "false"))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def _contains_dataset(e: Expression) -> bool:
    if isinstance(e, DatasetRef):
        return True
    if isinstance(e, Not):
        return _contains_dataset(e.body)
    if isinstance(e, Comparison):
        return _contains_dataset(e.left) or _contains_dataset(e.right)
    return isinstance(e, CollectionPredicate) and _contains_dataset(e.source)


def shape_of(e: Expression) -> int:
    """What an expression needs: its row, an aggregate of the data set, or access to all of it."""
    if isinstance(e, DatasetRef):
        return GLOBAL
    if isinstance(e, Not):
        return shape_of(e.body)
    if isinstance(e, Comparison):
        return max(shape_of(e.left), shape_of(e.right))
    if isinstance(e, CollectionPredicate):
        return AGGREGATE if _contains_dataset(e) else shape_of(e.source)
    return LOCAL


def rule_shape(r: Rule) -> int:
    return max(shape_of(r.expression), LOCAL if r.applies_when is None else shape_of(r.applies_when))


@dataclass(frozen=True)
class DatasetPlan:
    policies: PolicySet
    local: tuple[tuple[str, Rule], ...]
    aggregate: tuple[tuple[str, Rule], ...]
    row_budget: int = DEFAULT_ROW_BUDGET
    cap: int = DEFAULT_CAP
    specs: tuple[DatasetSpec, ...] = ()


def plan(policies: PolicySet, row_budget: int = DEFAULT_ROW_BUDGET, cap: int = DEFAULT_CAP, specs: list[DatasetSpec] | None = None) -> DatasetPlan:
    """Refuses, before any row is read, what does not run in one pass with bounded state: also data sets that need a global index."""
    if found := [s.id for s in specs or [] if s.requires_global_index]:
        raise Refusal("GLOBAL_ACCESS", f"data sets need an index over all rows: {', '.join(found)}")
    shaped = [(p, r, rule_shape(r)) for p, r in policies.rules()]
    if found := [r.id for _, r, s in shaped if s == GLOBAL]:
        raise Refusal("GLOBAL_ACCESS", f"rules need access to a whole data set at once: {', '.join(found)}")
    odd = [r.id for _, r, s in shaped if s == AGGREGATE and (r.applies_when is not None or not isinstance(r.expression, CollectionPredicate) or not isinstance(r.expression.source, DatasetRef))]
    if odd:
        raise Refusal("AGGREGATE_NOT_EXECUTABLE", f"only an ungated collection predicate right over a data set can be folded: {', '.join(odd)}")
    if row_budget <= 0 or cap < 0:
        raise Refusal("BUDGET", "the row budget must be positive and the cap not negative")
    return DatasetPlan(policies, tuple((p, r) for p, r, s in shaped if s == LOCAL), tuple((p, r) for p, r, s in shaped if s == AGGREGATE), row_budget, cap, tuple(specs or ()))


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Numbers the rows 1, 2, ... by columns, without sorting them in one task: rows are range-partitioned and sorted, written once, counted
    by partition, and numbered from prefix sums. Rows that the columns don't tell apart are numbered in either order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (at,) = free_names(df.columns, "at")
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialize(placed, "ordinal")
    part = F.shiftright(at, 33)  # the partition is above the row's place in it
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    base, bases = 0, []
    for p, c in counts:
        bases.append((p, base))
        base += c
    number, first = free_names(df.columns, "part_number", "part_base")
    side = F.broadcast(df.sparkSession.createDataFrame(bases, f"`{number}` long, `{first}` long"))
    within = F.col(at).bitwiseAND((1 << 33) - 1)
    return placed.join(side, part == F.col(number)).withColumn("ordinal", within + F.col(first) + 1).drop(at, number, first)


def evaluate_dataset(df: DataFrame, the_plan: DatasetPlan, ordinal: str, document: str | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, metrics) of a plan over rows numbered by `ordinal` (1, 2, ... without gaps if there may be more than the budget). With
    `by`, each value of that column is a data set with row numbers and a budget of its own, and both tables have that column too.

    outcomes: policy_id, rule_id, outcome (PASSED, VIOLATED, ERROR, AGGREGATE), violations, last_row, value, message.
    metrics: rows_consumed, rows_refused, budget_limit, accumulators_used.
    One projection and one aggregate, whose partial sums are a row for each task.
    """
    compiler, budget, cap = Compiler(df.schema, document), the_plan.row_budget, the_plan.cap
    df, _ = compiler.project(df, *[e for _, r in the_plan.local for e in (r.expression, r.applies_when)])
    n = F.col(ordinal).cast("long")
    inside = n <= budget
    columns, aggs = [n.alias("_n"), inside.alias("_in")], [F.count(F.lit(1)).alias("_rows"), F.count_if("_in").alias("_consumed")]
    for i, (_, r) in enumerate(the_plan.local):
        columns.append(compiler.outcome(r).alias(f"_o{i}"))
        here = lambda what, i=i: F.col("_in") & (F.col(f"_o{i}") == what)
        aggs += [F.count_if(here("VIOLATED")).alias(f"_v{i}"), F.max(F.when(here("VIOLATED"), F.col("_n"))).alias(f"_l{i}"), F.min(F.when(here("ERROR"), F.col("_n"))).alias(f"_e{i}")]
    for j, (_, r) in enumerate(the_plan.aggregate):
        columns.append(compiler.matches_row(r.expression.predicate).alias(f"_m{j}"))
        decides = F.col("_in") & (~F.col(f"_m{j}") if r.expression.op == "ALL" else F.col(f"_m{j}"))
        aggs += [F.count_if(F.col("_in") & F.col(f"_m{j}")).alias(f"_c{j}"), F.min(F.when(decides, F.col("_n"))).alias(f"_d{j}")]
    total = df.select(*columns, *([F.col(by)] if by else [])).groupBy(*([by] if by else [])).agg(*aggs)
    more = [F.col(by)] if by else []
    over = F.col("_rows") > F.col("_consumed")
    stop = F.lit(f"row_budget cap {budget} reached after {budget}")
    null, zero = F.lit(None), F.lit(0).cast("long")

    def row(p: str, r: Rule, outcome, violations, last, value, message):
        fields = {"policy_id": F.lit(p), "rule_id": F.lit(r.id), "outcome": outcome, "violations": violations, "last_row": last.cast("long"), "value": value.cast("long"), "message": message.cast("string")}
        broken = over & (fields["outcome"] != "ERROR")
        blank = {"outcome": F.lit("ERROR"), "violations": zero, "last_row": null.cast("long"), "value": null.cast("long"), "message": stop}
        return F.struct(*[(F.when(broken, blank[k]).otherwise(v) if k in blank else v).alias(k) for k, v in fields.items()])

    rows, refused = [], F.when(over, F.lit(1)).otherwise(F.lit(0)).cast("long")
    for i, (p, r) in enumerate(the_plan.local):
        v, last, err = (F.col(f"_{k}{i}") for k in "vle")
        bad = err.isNotNull()
        outcome = F.when(bad, "ERROR").when(v > 0, "VIOLATED").otherwise("PASSED")
        rows.append(row(p, r, outcome, F.when(~bad, v).otherwise(zero), F.when(~bad, last), null, F.when(bad, F.concat(F.lit("typed refusal at row "), err.cast("string")))))
    for j, (p, r) in enumerate(the_plan.aggregate):
        c, first = F.col(f"_c{j}"), F.col(f"_d{j}")
        if r.expression.op == "COUNT":
            bad = c > cap
            refused = refused + F.when(bad, c - cap).otherwise(zero)
            rows.append(row(p, r, F.when(bad, "ERROR").otherwise("AGGREGATE"), zero, null, F.when(~bad, c), F.when(bad, F.lit(f"count cap {cap} reached after {cap}"))))
        else:
            # undecided after `cap` rows, and another row came
            bad = (F.col("_consumed") > cap) & (first.isNull() | (first > cap))
            refused = refused + F.when(bad, F.col("_consumed") - cap).otherwise(zero)
            holds = first.isNotNull() if r.expression.op == "ANY" else first.isNull()
            outcome = F.when(bad, "ERROR").when(holds, "PASSED").otherwise("VIOLATED")
            no = ~bad & ~holds
            rows.append(row(p, r, outcome, F.when(no, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.when(no, F.lit(-1)), null, F.when(bad, F.lit(f"count cap {cap} reached after {cap}"))))
    none = "policy_id string, rule_id string, outcome string, violations long, last_row long, value long, message string"
    outcomes = total.select(*more, F.explode(F.array(*rows)).alias("x")).select(*more, "x.*") if rows else df.limit(0).select(*more).join(df.sparkSession.createDataFrame([], none))
    metrics = total.select(*more, F.col("_consumed").alias("rows_consumed"), refused.alias("rows_refused"), F.lit(budget).cast("long").alias("budget_limit"), F.lit(len(the_plan.aggregate)).cast("long").alias("accumulators_used"))
    return outcomes, metrics


def sum_exact(df: DataFrame, column: str, *, cap: int = DEFAULT_CAP, ordinal: str | None = None) -> DataFrame:
    """sum_value (the exact sum as plain decimal text without zeros at its end), rows_summed, type_mismatches, refusal, of one column.

    Whole numbers and decimals are added as they are, and doubles as the shortest decimals that stand for them, without rounding. A row that is
    null, not finite or of another type refuses the sum (TYPE_MISMATCH), and so does a row beyond the cap (SUM); sum_value is then null. With
    `ordinal` the refusal is that of the first row refused, and rows_summed the rows before it; else a mismatch counts before the cap.
    Digits are added by exponent, so the shuffle has a row for each exponent and task.
    """
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    digits, exponent, number = F.lit(None).cast("string"), F.lit(0), F.lit(False)
    if isinstance(kind, T.IntegralType):
        digits, number = c.cast("string"), c.isNotNull()
    elif isinstance(kind, T.FractionalType):  # decimals and doubles
        text = c.cast("string") if isinstance(kind, T.DecimalType) else c.cast("double").cast("string")
        part = lambda i: F.regexp_extract(text, r"^(-?\d+)(?:\.(\d+))?(?:E([+-]?\d+))?$", i)
        number = c.isNotNull() if isinstance(kind, T.DecimalType) else F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
        digits = F.when(number, F.concat(part(1), part(2)))
        exponent = F.when(number, F.coalesce(F.when(part(3) != "", part(3).cast("int")), F.lit(0)) - F.length(part(2)))
    place = F.col(f"`{ordinal}`").cast("long") if ordinal else F.lit(None).cast("long")
    each = df.select(number.alias("number"), digits.alias("d"), exponent.cast("int").alias("e"), place.alias("at"))
    # digits in two halves, whose sums keep within 38
    plain, sign = F.ltrim(F.col("d"), F.lit("-")), F.when(F.startswith("d", F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    cut = F.greatest(F.length(plain) - 18, F.lit(0))
    high = F.when(cut > 0, F.substring(plain, F.lit(1), cut).cast("decimal(20,0)") * sign)
    low = F.substring(plain, cut + 1, F.lit(18)).cast("decimal(18,0)") * sign
    per = each.groupBy("e").agg(
        F.sum(F.when(F.col("number"), high)).alias("high"), F.sum(F.when(F.col("number"), low)).alias("low"),
        F.count_if("number").alias("n"), F.count_if(~F.col("number")).alias("bad"), F.min(F.when(~F.col("number"), F.col("at"))).alias("first_bad"),
    )
    one = per.agg(F.collect_list(F.struct("e", "high", "low")).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.min("first_bad").alias("first_bad"))  # a part for each exponent

    def run(frames):
        for pdf in frames:
            out = []
            for parts, n, bad, first_bad in zip(pdf["parts"], pdf["n"], pdf["bad"], pdf["first_bad"]):
                found = Fraction(0)
                for p in parts:
                    if p["low"] is not None:
                        found += (int(p["high"] or 0) * 10**18 + int(p["low"])) * Fraction(10) ** p["e"]
                late = first_bad is not None and first_bad == first_bad and first_bad > cap
                refusal = "SUM" if n + bad > cap and (late or not bad) else "TYPE_MISMATCH" if bad else None
                done = min(cap, n) if refusal != "TYPE_MISMATCH" else int(first_bad) - 1 if first_bad == first_bad and first_bad is not None else 0
                out.append((None if refusal else plain_decimal(found), int(done), int(bad), refusal))
            yield pd.DataFrame(out, columns=["sum_value", "rows_summed", "type_mismatches", "refusal"])

    return one.mapInPandas(run, "sum_value string, rows_summed long, type_mismatches long, refusal string")


def plain_decimal(value: Fraction) -> str:
    """A fraction of a power of ten as text without an exponent."""
    scale, n, d = 0, value.numerator, value.denominator
    while n % d:
        scale, n = scale + 1, n * 10
    digits = str(abs(n // d)).rjust(scale + 1, "0")
    return ("-" if n < 0 else "") + (digits[:-scale] + "." + digits[-scale:] if scale else digits)


def multi_file_outcome(per_file: DataFrame) -> DataFrame:
    """policy_id, rule_id, outcome, violations, last_row, message over several files in the order of `file_no`, each evaluated on its own.

    The run ends with the first file that has an error of any rule: files after it don't count. Violations add up, the last row is that of
    the last file with one, and an error is the rule's. `per_file` has outcomes' columns and `file_no`, a row for each rule and file.
    """
    stop = F.broadcast(per_file.groupBy(F.lit(1).alias("one")).agg(F.min(F.when(F.col("outcome") == "ERROR", F.col("file_no"))).alias("stop")))  # one row
    run = per_file.withColumn("one", F.lit(1)).join(stop, "one").where("stop is null or file_no <= stop").drop("one", "stop")
    return run.groupBy("policy_id", "rule_id").agg(
        F.when(F.count_if(F.col("outcome") == "ERROR") > 0, "ERROR").when(F.sum("violations") > 0, "VIOLATED").otherwise(F.min("outcome")).alias("outcome"),
        F.sum("violations").alias("violations"), F.max_by("last_row", F.when(F.col("last_row").isNotNull(), F.col("file_no"))).alias("last_row"), F.min_by("message", F.when(F.col("outcome") == "ERROR", F.col("file_no"))).alias("message"),
    )
