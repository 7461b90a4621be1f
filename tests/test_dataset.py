"""Planner refusals and single-pass aggregates, held against a fold over rows."""

import pytest
from pyspark.sql import functions as F

from verdictframe.functions.interpreter import evaluate_rule, matches
from verdictframe.operators import crossref, dataset
from verdictframe.operators.dataset import AGGREGATE, GLOBAL, LOCAL
from verdictframe.plans import dsl
from verdictframe.plans.ir import NUMBER, TEXT, Comparison, Literal, Refusal, number
from verdictframe.sources.decoders import parse_json

ROWS = dsl.dataset("rows")
NUMBERS = dsl.select("n", expected=NUMBER)


def one(rule):
    return dsl.policy_set("s", dsl.policy("p", rule))


def test_shapes_and_refusals():
    field = dsl.root("x").number()
    assert dataset.rule_shape(dsl.rule("r", require=field.gt(1))) == LOCAL
    assert dataset.rule_shape(dsl.rule("r", require=dsl.all_of(ROWS, NUMBERS))) == AGGREGATE
    assert dataset.rule_shape(dsl.rule("r", require=Comparison(ROWS, "EQ", Literal(number(1))))) == GLOBAL
    for r in (dsl.rule("r", require=Comparison(ROWS, "EQ", Literal(number(1)))), dsl.rule("r", require=dsl.not_(dsl.all_of(ROWS, NUMBERS))), dsl.rule("r", require=dsl.count_of(ROWS, NUMBERS).gt(1)), dsl.rule("r", require=dsl.all_of(ROWS, NUMBERS), applies_when=field.gt(1))):
        with pytest.raises(Refusal):
            dataset.plan(one(r))
    with pytest.raises(Refusal):
        dataset.plan(one(dsl.rule("r", require=field.gt(1))), row_budget=0)


def test_dataset_digest():
    import hashlib

    spec = dataset.DatasetSpec("orders", "CSV")
    assert spec.digest == hashlib.sha256(b"orders|CSV|row|false").hexdigest()[:16] != dataset.DatasetSpec("orders", "CSV", requires_global_index=True).digest


def fold(rows, rule, budget, cap):
    """The outcome by reading row after row."""
    e = rule.expression
    seen = count = violations = 0
    last = first_error = None
    decided, verdict, refused = False, getattr(e, "op", "") != "ANY", False
    for i, row in enumerate(rows, 1):
        if i > budget:
            return "ERROR", 0, None, None
        if getattr(e, "source", None) == ROWS:
            m = matches(e.predicate, row)
            if e.op == "COUNT":
                if m and count >= cap:
                    refused = True
                elif m:
                    count += 1
            elif not decided:
                if seen >= cap:
                    refused = True
                    continue
                seen += 1
                if m != (e.op == "ALL"):
                    decided, verdict = True, e.op == "ANY"
        else:
            o = evaluate_rule(rule, row).outcome
            if o == "VIOLATED":
                violations, last = violations + 1, i
            elif o == "ERROR" and first_error is None:
                first_error = i
    if getattr(e, "source", None) == ROWS:
        if refused:
            return "ERROR", 0, None, None
        if e.op == "COUNT":
            return "AGGREGATE", 0, None, count
        return ("PASSED", 0, None, None) if verdict else ("VIOLATED", 1, -1, None)
    if first_error is not None:
        return "ERROR", 0, None, None
    return ("VIOLATED", violations, last, None) if violations else ("PASSED", 0, None, None)


DOCS = ['{"n": 1}', '{"n": "skip"}', '{"n": 2}', '{"m": 1}', '{"n": null}', '{"n": 3}', '{"n": "skip"}']
RULES = [dsl.rule(f"{op}-{t}", require=getattr(dsl, op)(ROWS, dsl.select("n", expected=t)) if op != "count_of" else dsl.count_of(ROWS, dsl.select("n", expected=t)).expression) for op in ("all_of", "any_of", "none_of", "count_of") for t in (NUMBER, TEXT)]
RULES += [dsl.rule("local", require=dsl.optional_root("n").number().lt(3)), dsl.rule("gated", require=dsl.root("m").number().gt(5), applies_when=dsl.root("m").number().gt(0)), dsl.rule("optional", require=dsl.all_of(ROWS, dsl.select("n", optional=True)))]


@pytest.mark.parametrize(("n", "budget", "cap"), [(7, 100, 100), (7, 5, 100), (7, 100, 1), (3, 3, 2), (0, 10, 0), (1, 10, 0)])
def test_outcomes_are_those_of_a_fold(spark, n, budget, cap):
    rows = [(i, d) for i, d in enumerate(DOCS[:n], 1)]
    df = spark.createDataFrame(rows, "no long, text string").select("no", F.parse_json("text").alias("doc"))
    out, metrics = dataset.evaluate_dataset(df, dataset.plan(dsl.policy_set("s", dsl.policy("p", *RULES)), budget, cap), "no", document="doc")
    got = {r.rule_id: (r.outcome, r.violations, r.last_row, r.value) for r in out.collect()}
    trees = [parse_json(d)[0] for _, d in rows]
    assert got == {r.id: fold(trees, r, budget, cap) for r in RULES}
    assert metrics.first().rows_consumed == min(n, budget)


def test_ordinals_have_no_gaps(spark):
    df = spark.range(0, 3000, 7).repartition(5)
    got = [(r.id, r.ordinal) for r in dataset.with_ordinal(df, "id").collect()]
    assert sorted(got) == [(x, i) for i, x in enumerate(range(0, 3000, 7), 1)]
    assert dataset.with_ordinal(df.limit(0), "id").count() == 0


def test_one_aggregate_without_a_window(spark, sf):
    from verdictframe.queries import ds_local_tally

    plan = ds_local_tally(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan and "Window" not in plan and "Python" not in plan


def test_extensions_are_asked_for(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x long"), spark.createDataFrame([(1,)], "y long")
    with pytest.raises(Refusal):
        crossref.related(a, b, F.col("x") == F.col("y"), "ANY")
    assert [r.x for r in crossref.related(a, b, F.col("x") == F.col("y"), "ANY", requires_global_index=True).collect()] == [2]
    assert [r.x for r in crossref.related(a, b, F.col("x") == F.col("y"), "NONE", requires_global_index=True).collect()] == [1]


def test_streams_tally_row_rules(spark, tmp_path):
    from datetime import datetime

    from verdictframe.streaming.runner import stream_outcomes

    spark.createDataFrame([(datetime(2025, 1, 1, 0, i), float(i)) for i in range(30)], "ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    rules = one(dsl.rule("v", require=dsl.root("value").number().gte(10)))
    source = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/in")
    q = stream_outcomes(source, rules, "ts").writeStream.outputMode("complete").format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.outcome, r.n) for r in spark.sql("SELECT * FROM outcomes").collect()} == {("PASSED", 20), ("VIOLATED", 10)}
    with pytest.raises(Refusal):
        stream_outcomes(source, one(dsl.rule("v", require=dsl.all_of(ROWS, NUMBERS))), "ts")


def test_sums_are_exact(spark):
    from decimal import Decimal

    def total(values, kind, **more):
        r = dataset.sum_exact(spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"n long, v {kind}"), "v", **more).first()
        return r.sum_value, r.rows_summed, r.type_mismatches, r.refusal

    assert total([1e-7, 2e-7], "double") == ("0.0000003", 2, 0, None) and total([0.1] * 10, "double") == ("1", 10, 0, None)
    assert total([1e30, 1.0, -1e30, 5e-324], "double")[0] == "1." + "0" * 323 + "49"
    assert total([float("nan"), 1.0], "double") == (None, 0, 1, "TYPE_MISMATCH") and total([1.0, float("inf")], "double", ordinal="n") == (None, 1, 1, "TYPE_MISMATCH")
    assert total([1, None], "long") == (None, 0, 1, "TYPE_MISMATCH") and total([2**63 - 1] * 4 + [-5], "long")[0] == str(4 * (2**63 - 1) - 5)
    big = Decimal("9" * 38)
    assert total([big] * 3, "decimal(38,0)")[0] == str(3 * int(big)) and total([Decimal("-0.000000000000000003")] * 2, "decimal(38,18)")[0] == "-0.000000000000000006"
    assert total([1, 2, 3], "int", cap=2) == (None, 2, 0, "SUM") and total([1, 2, 3], "int", cap=3)[3] is None and total([], "int") == ("0", 0, 0, None)
    assert total([1.0, 2.0, None], "double", cap=2, ordinal="n") == (None, 2, 1, "SUM") and total([1.0, None, 2.0], "double", cap=1, ordinal="n")[3] == "SUM"
    assert total(["1"], "string") == (None, 0, 1, "TYPE_MISMATCH")


def test_files_have_budgets_of_their_own_and_the_first_error_ends_the_run(spark):
    rows = spark.createDataFrame([(f, n, "x" if (f, n) != (2, 3) else None) for f in (1, 2, 3) for n in range(1, 6)], "file_no int, n long, t string")
    the_plan = dataset.plan(one(dsl.rule("t", require=dsl.root("t").text().eq_text("y"))), row_budget=5)
    per_file, metrics = dataset.evaluate_dataset(rows, the_plan, "n", by="file_no")
    assert {(r.file_no, r.outcome, r.violations) for r in per_file.collect()} == {(1, "VIOLATED", 5), (2, "ERROR", 0), (3, "VIOLATED", 5)} and {r.rows_consumed for r in metrics.collect()} == {5}
    r = dataset.multi_file_outcome(per_file).first()
    assert (r.outcome, r.violations, r.last_row, r.message) == ("ERROR", 5, 5, "typed refusal at row 3")
    r = dataset.multi_file_outcome(per_file.where("file_no <> 2")).first()
    assert (r.outcome, r.violations, r.last_row) == ("VIOLATED", 10, 5)
    with pytest.raises(Refusal):
        dataset.plan(the_plan.policies, specs=[dataset.DatasetSpec("d", "csv", requires_global_index=True)])
