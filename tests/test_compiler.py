"""Compiled rules against the interpreter, on documents as VARIANT and on typed columns."""

import json
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictframe.functions.interpreter import evaluate_rule
from verdictframe.operators import evaluate
from verdictframe.operators.compiler import Compiler
from verdictframe.plans import dsl
from verdictframe.plans.ir import BOOLEAN, MAPPING, NUMBER, SEQUENCE, TEXT, CollectionPredicate, Comparison, FieldRef, Literal, Not, Num, Refusal, Selector, number
from verdictframe.sources.decoders import parse_json

VALUES = [1, 2, 0, -3, Decimal("1.5"), "x", "1", True, False, None, [], [1, "a"], ["a", "b"], {}, {"value": 1}, {"b": "x"}, {"b": 2, "c": [1]}, [{"b": 1}, {"b": "t"}], [[1], 2], {"0": 5}]
PATHS = [("a",), ("a", "b"), ("b",), ("a", "0"), ("a", "value"), ("a", "1", "b")]


def expressions(rng: random.Random):
    ref = lambda: FieldRef(rng.choice(PATHS), rng.choice((NUMBER, TEXT, BOOLEAN, SEQUENCE, MAPPING)), rng.random() < 0.3)
    selector = lambda: Selector(rng.choice(((), ("value",), ("b",), ("value", "0"), ("c",))), rng.choice((None, NUMBER, TEXT, MAPPING)), rng.random() < 0.3)
    literal = lambda: Literal(rng.choice((number(1), Num(Decimal("1.5"), "BIG_DECIMAL"), Num(1.5, "DOUBLE"), "x", True)))
    pick = rng.random()
    if pick < 0.45:
        left = dsl.count_of(ref(), selector()).expression if rng.random() < 0.25 else ref()
        return Comparison(left, rng.choice(("EQ", "NEQ", "GT", "GTE", "LT", "LTE", "TEXT_EQUALS", "BOOLEAN_EQUALS")), rng.choice((literal, ref))())
    if pick < 0.75:
        return CollectionPredicate(rng.choice(("ALL", "ANY", "NONE", "COUNT")), FieldRef(rng.choice(PATHS), rng.choice((SEQUENCE, MAPPING, NUMBER)), rng.random() < 0.3), selector())
    return rng.choice((literal(), ref(), Not(Comparison(ref(), "GT", literal()))))


def test_documents_agree_with_the_interpreter(spark):
    rng = random.Random(7)
    rules = [dsl.rule(f"r{i}", require=expressions(rng), applies_when=expressions(rng) if rng.random() < 0.3 else None) for i in range(45)]
    docs = [json.dumps({"a": a, "b": b}, default=float) for a in VALUES for b in rng.sample(VALUES, 3)] + ["{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, text string").select("id", F.parse_json("text").alias("doc"))
    got = {}
    for k in range(0, len(rules), 15):
        part = dsl.policy_set("s", dsl.policy("p", *rules[k : k + 15]))
        got |= {(int(r.resource_id), r.rule_id): (r.outcome, r.code, r.location, r.message, r.expected) for r in evaluate.evaluate(df, part, "id", document="doc").collect()}
    compiler = Compiler(df.schema, "doc")
    short = {(row.id, rules[k].id): row[f"o{k}"] for row in df.select("id", *[compiler.outcome(r).alias(f"o{k}") for k, r in enumerate(rules)]).collect() for k in range(len(rules))}
    for i, d in enumerate(docs):
        tree = parse_json(d)[0]
        for r in rules:
            e = evaluate_rule(r, tree)
            assert short[i, r.id] == e.outcome, (d, r)
            v = e.violations[0] if e.violations else None
            want = (e.outcome, *((v.code, v.location, v.message, v.expected) if v else (None,) * 4))
            assert got[i, r.id] == want, (d, r)


DOUBLES = [0.1, 0.05, 0.07, 1.0, -2.5, 9007199254740992.0, 1e300, 5e-324]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(("EQ", "NEQ", "GT", "GTE", "LT", "LTE")), st.one_of(st.decimals(-10, 10, places=3), st.sampled_from([Decimal("0.1"), Decimal("0.07"), Decimal("9007199254740993"), Decimal("1e400")]), st.integers(-(2**70), 2**70), st.sampled_from(DOUBLES)))
def test_typed_comparisons_are_exact(spark, op, literal):
    rows = [(i, x, int(x) if abs(x) < 1e18 else i) for i, x in enumerate(DOUBLES)]
    df = spark.createDataFrame(rows, "id long, d double, n long")
    rules = [dsl.rule(c, require=Comparison(FieldRef((c,), NUMBER), op, Literal(number(literal)))) for c in ("d", "n")]
    got = {(int(r.resource_id), r.rule_id): r.outcome for r in evaluate.evaluate(df, dsl.policy_set("s", dsl.policy("p", *rules)), "id").collect()}
    for i, d, n in rows:
        for r, v in zip(rules, (Num(d, "DOUBLE"), Num(n))):
            assert got[i, r.id] == evaluate_rule(r, {r.id: v}).outcome, (op, literal, v)


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, None, [1, None], {"k": "v"}, (2, None), float("nan")), (2, "t", None, {}, None, 1.0)], "id long, t string, xs array<int>, m map<string,string>, s struct<a:int,b:string>, d double")
    outcome = lambda e: [r.outcome for r in sorted(evaluate.evaluate(df, dsl.policy_set("s", dsl.policy("p", dsl.rule("r", require=e))), "id").collect(), key=lambda r: r.resource_id)]
    assert outcome(dsl.root("t").text().eq_text("t")) == ["ERROR", "PASSED"]
    assert outcome(dsl.root("absent").text().eq_text("t")) == ["VIOLATED", "VIOLATED"]
    assert outcome(dsl.optional_root("absent").text().eq_text("t")) == ["NOT_APPLICABLE", "NOT_APPLICABLE"]
    assert outcome(dsl.root("m").field("k").text().eq_text("v")) == ["PASSED", "VIOLATED"]
    assert outcome(dsl.root("s").field("a").number().eq(2)) == ["PASSED", "VIOLATED"]
    assert outcome(dsl.root("s").field("b").text().eq_text("x")) == ["ERROR", "VIOLATED"]
    assert outcome(dsl.root("xs").field("0").number().eq(1)) == ["PASSED", "VIOLATED"]
    assert outcome(dsl.root("d").number().lt(5)) == ["ERROR", "PASSED"]
    xs = dsl.root("xs").typed(SEQUENCE).expression
    assert outcome(dsl.all_of(xs, dsl.select("value", expected=NUMBER))) == ["VIOLATED", "ERROR"]
    assert outcome(dsl.count_of(xs, dsl.select("value", expected=NUMBER)).eq(1)) == ["PASSED", "ERROR"]


def test_pruning_and_refusals(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = evaluate.evaluate(df, dsl.policy_set("s", dsl.policy("p", dsl.rule("r", require=dsl.root("l_tax").number().gte(0)))), "l_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "l_comment" not in plan and plan.count("l_quantity") == 0
    with pytest.raises(Refusal):
        Compiler(spark.createDataFrame([], "ts timestamp").schema).boolean(dsl.root("ts").text().eq_text("x"))
    with pytest.raises(Refusal):
        Compiler(df.schema).boolean(dsl.dataset("rows"))


def test_a_thousand_rules_on_one_document():
    tree = {"spec": {"replicas": number(5)}}
    outcomes = [evaluate_rule(dsl.rule(f"r{i}", require=dsl.root("spec").field("replicas").number().gte(i % 10)), tree).outcome for i in range(1000)]
    assert outcomes.count("PASSED") == 600 and outcomes.count("VIOLATED") == 400
