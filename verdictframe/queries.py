"""The engine's registered queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions.storage import fresh_path
from verdictframe.operators import crossref, dataset, evaluate, findings, governance
from verdictframe.plans import dsl
from verdictframe.plans.ir import BOOLEAN, NUMBER, TEXT, Authority, PolicySet, Rule
from verdictframe.streaming.runner import stream_outcomes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _set(*rules: Rule, policy: str = "p") -> PolicySet:
    return dsl.policy_set("s", dsl.policy(policy, *rules))


def _rule_query(name: str, source: str, key: str, columns: tuple[str, ...], the_rule: Rule, case: str, where=lambda df: df) -> None:
    """A query that evaluates one rule on each row of a table; `case` is the outcome in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = where(table(spark, sf_dir, source).select(key, *columns))
        return evaluate.evaluate(df, _set(the_rule), key).select("resource_id", "rule_id", "outcome")

    register(name, f"SELECT CAST({key} AS VARCHAR) AS resource_id, '{the_rule.id}' AS rule_id, {case} AS outcome FROM {source}")(run)


# comparisons

_PRICE = dsl.root("o_totalprice").number()
for _op, _sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _rule_query(
        f"rule_{_op}", "orders", "o_orderkey", ("o_totalprice",), dsl.rule(f"price-{_op}", require=getattr(_PRICE, _op)(Decimal("150000.25"))),
        f"CASE WHEN o_totalprice IS NULL OR NOT isfinite(o_totalprice) THEN 'ERROR' WHEN o_totalprice {_sign} 150000.25::DOUBLE THEN 'PASSED' ELSE 'VIOLATED' END",
    )
_rule_query(
    "rule_integral_literal", "lineitem", "l_orderkey", ("l_linenumber",), dsl.rule("line", require=dsl.root("l_linenumber").number().lte(Decimal("3.5"))),
    "CASE WHEN l_linenumber IS NULL THEN 'ERROR' WHEN l_linenumber <= 3 THEN 'PASSED' ELSE 'VIOLATED' END",
)
_rule_query(
    "rule_text_equals", "orders", "o_orderkey", ("o_orderstatus",), dsl.rule("open", require=dsl.root("o_orderstatus").text().eq_text("O")),
    "CASE WHEN o_orderstatus IS NULL THEN 'ERROR' WHEN o_orderstatus = 'O' THEN 'PASSED' ELSE 'VIOLATED' END",
)
_rule_query(
    "rule_bool_equals", "labels", "doc_id", ("toxic",), dsl.rule("clean", require=dsl.root("toxic").boolean().eq_bool(False)),
    "CASE WHEN toxic IS NULL THEN 'ERROR' WHEN toxic = 0 THEN 'PASSED' ELSE 'VIOLATED' END", where=lambda df: df.withColumn("toxic", F.col("toxic") > 0),
)
_rule_query(
    "rule_not", "orders", "o_orderkey", ("o_orderpriority",), dsl.rule("not-urgent", require=dsl.not_(dsl.root("o_orderpriority").text().eq_text("1-URGENT"))),
    "CASE WHEN o_orderpriority IS NULL THEN 'ERROR' WHEN o_orderpriority <> '1-URGENT' THEN 'PASSED' ELSE 'VIOLATED' END",
)

@register(
    "rule_forbid_inverted",
    "SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, l_linenumber, CASE WHEN l_discount <= 0.05::DOUBLE THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, "
    "CASE WHEN l_discount <= 0.05::DOUBLE THEN NULL ELSE '<=0.05' END AS expected FROM lineitem",
)
def rule_forbid_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    out = evaluate.evaluate(df, _set(dsl.rule("big-discount", forbid=dsl.root("l_discount").number().gt(0.05))), "l_orderkey", keep={"l_linenumber": "l_linenumber"})
    return out.select("resource_id", "l_linenumber", "outcome", "expected")


@register(
    "rule_params",
    "SELECT CAST(p_partkey AS VARCHAR) AS resource_id, CASE WHEN p_size <= 25 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, "
    "CASE WHEN p_size <= 25 THEN NULL ELSE '<=25.0' END AS expected, CASE WHEN p_size <= 25 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS actual FROM part",
)
def rule_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    the_rule = dsl.rule("size", require=dsl.root("p_size").number().lte(dsl.ref("max")), params={"max": 25})
    return evaluate.evaluate(df, _set(the_rule), "p_partkey").select("resource_id", "outcome", "expected", "actual")


_EVENT = dsl.root("value").number().gte(10)
_GATES = {
    "gated": dsl.rule("gated", require=_EVENT, applies_when=dsl.root("event_type").text().eq_text("purchase")),
    "missing-gate": dsl.rule("missing-gate", require=_EVENT, applies_when=dsl.root("absent").number().gt(0)),
    "error-gate": dsl.rule("error-gate", require=_EVENT, applies_when=dsl.root("event_type").number().gt(0)),
}


@register(
    "rule_applies_when",
    "SELECT CAST(event_id AS VARCHAR) AS resource_id, g.rule_id, CASE g.rule_id WHEN 'gated' THEN CASE WHEN event_type <> 'purchase' THEN 'NOT_APPLICABLE' WHEN value >= 10 THEN 'PASSED' ELSE 'VIOLATED' END "
    "WHEN 'missing-gate' THEN 'NOT_APPLICABLE' ELSE 'ERROR' END AS outcome, CASE g.rule_id WHEN 'error-gate' THEN 'expected NUMBER at event_type, got TEXT' WHEN 'gated' THEN CASE WHEN event_type = 'purchase' AND value < 10 THEN 'gated' END END AS message "
    "FROM events CROSS JOIN (VALUES ('gated'), ('missing-gate'), ('error-gate')) g(rule_id)",
)
def rule_applies_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return evaluate.evaluate(df, _set(*_GATES.values()), "event_id").select("resource_id", "rule_id", "outcome", "message")


def _events_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("props"))


_PROPS = dsl.root("props")
_DOCUMENT_RULES = (
    dsl.rule("k-high", require=_PROPS.field("k").number().gte(50)),
    dsl.rule("zz-required", require=_PROPS.field("zz").number().gte(1)),
    dsl.rule("zz-optional", require=_PROPS.optional_field("zz").number().gte(1)),
    dsl.rule("k-text", require=_PROPS.field("k").text().eq_text("x")),
    dsl.rule("deep-missing", require=_PROPS.field("k").field("inner").number().eq(1)),
)


@register(
    "rule_document_fields",
    "WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT CAST(event_id AS VARCHAR) AS resource_id, r.rule_id, "
    "CASE r.rule_id WHEN 'k-high' THEN CASE WHEN k >= 50 THEN 'PASSED' ELSE 'VIOLATED' END WHEN 'zz-required' THEN 'VIOLATED' WHEN 'zz-optional' THEN 'NOT_APPLICABLE' WHEN 'k-text' THEN 'ERROR' ELSE 'VIOLATED' END AS outcome, "
    "CASE r.rule_id WHEN 'k-high' THEN CASE WHEN k >= 50 THEN NULL ELSE 'COMPARISON_FAILED' END WHEN 'zz-required' THEN 'MISSING_REQUIRED_VALUE' WHEN 'zz-optional' THEN NULL WHEN 'k-text' THEN 'TYPE_MISMATCH' ELSE 'MISSING_REQUIRED_VALUE' END AS code, "
    "CASE r.rule_id WHEN 'k-high' THEN CASE WHEN k >= 50 THEN NULL ELSE CAST(k AS VARCHAR) END WHEN 'k-text' THEN 'NUMBER' END AS actual, "
    "CASE r.rule_id WHEN 'k-high' THEN CASE WHEN k >= 50 THEN NULL ELSE 'props.k' END WHEN 'zz-required' THEN 'props.zz' WHEN 'k-text' THEN 'props.k' WHEN 'deep-missing' THEN 'props.k.inner' END AS location "
    "FROM e CROSS JOIN (VALUES ('k-high'), ('zz-required'), ('zz-optional'), ('k-text'), ('deep-missing')) r(rule_id)",
)
def rule_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(_events_documents(spark, sf_dir), _set(*_DOCUMENT_RULES), "event_id").select("resource_id", "rule_id", "outcome", "code", "actual", "location")


@register(
    "rule_violation_details",
    "SELECT CAST(c_custkey AS VARCHAR) AS resource_id, 'balance' AS rule_id, 'COMPARISON_FAILED' AS code, 'c_acctbal' AS location, 'balance must not be negative' AS message, '>=0' AS expected, CAST(c_acctbal AS VARCHAR) AS actual FROM customer WHERE c_acctbal < 0",
)
def rule_violation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    the_rule = dsl.rule("balance", require=dsl.root("c_acctbal").number().gte(0), message="balance must not be negative")
    out = evaluate.evaluate(df, _set(the_rule), "c_custkey").where("outcome = 'VIOLATED'")
    return out.select("resource_id", "rule_id", "code", "location", "message", "expected", "actual")


# collections


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"list":['), F.col("event_id").cast("string"), F.lit(',"'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.when(F.col("event_type") == "click", ',"more"').otherwise(""), F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("doc"))


def _in_list(op: str, expected: str):
    return getattr(dsl, op)(dsl.root("doc").field("list").typed("SEQUENCE").expression, dsl.select("value", expected=expected))


_COLLECTION_RULES = {
    "all": dsl.rule("all-numbers", require=_in_list("all_of", NUMBER)),
    "any": dsl.rule("any-boolean", require=_in_list("any_of", BOOLEAN)),
    "none": dsl.rule("none-boolean", require=_in_list("none_of", BOOLEAN)),
    "count": dsl.rule("count-text", require=_in_list("count_of", TEXT).lt(2)),
}
_COLLECTION_SQL = {
    "all": "'VIOLATED' AS outcome, 'COLLECTION_PREDICATE_FAILED' AS code, 'doc.list.1' AS location",
    "any": "'VIOLATED' AS outcome, 'COMPARISON_FAILED' AS code, 'doc.list' AS location",
    "none": "'PASSED' AS outcome, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS location",
    "count": "CASE WHEN event_type = 'click' THEN 'VIOLATED' ELSE 'PASSED' END AS outcome, CASE WHEN event_type = 'click' THEN 'COMPARISON_FAILED' END AS code, CASE WHEN event_type = 'click' THEN 'doc.list' END AS location",
}


def _collection_query(kind: str) -> None:
    @register(f"coll_{kind}", f"SELECT CAST(event_id AS VARCHAR) AS resource_id, {_COLLECTION_SQL[kind]} FROM events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate.evaluate(_lists(spark, sf_dir), _set(_COLLECTION_RULES[kind]), "event_id").select("resource_id", "outcome", "code", "location")


for _kind in _COLLECTION_RULES:
    _collection_query(_kind)


@register(
    "coll_typed_count",
    "SELECT CAST(vec_id AS VARCHAR) AS resource_id, CASE WHEN len(embedding) >= 64 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM embeddings",
)
def coll_typed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    numbers = dsl.count_of(dsl.root("embedding").typed("SEQUENCE").expression, dsl.select("value", expected=NUMBER))
    return evaluate.evaluate(df, _set(dsl.rule("dims", require=numbers.gte(64))), "vec_id").select("resource_id", "outcome")


@register(
    "coll_turns",
    "SELECT CAST(conv_id AS VARCHAR) AS resource_id, CASE WHEN count(role) = count(*) THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM conversations GROUP BY conv_id",
)
def coll_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    roles = dsl.all_of(dsl.root("turns").typed("SEQUENCE").expression, dsl.select("role", expected=TEXT))
    return evaluate.evaluate(df, _set(dsl.rule("roles", require=roles)), "conv_id").select("resource_id", "outcome")


# data sets

_DATA = dsl.dataset("rows")


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("n"), "value", "event_type", F.parse_json(F.when(F.col("event_type") == "click", '{"a": 1}').otherwise('{"b": "x"}')).alias("doc"))


def _dataset_query(name: str, op: str, selector, sql: str, cap: int = dataset.DEFAULT_CAP, budget: int = dataset.DEFAULT_ROW_BUDGET) -> None:
    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folded = getattr(dsl, op)(_DATA, selector)
        the_plan = dataset.plan(_set(dsl.rule("fold", require=getattr(folded, "expression", folded))), budget, cap)
        return dataset.evaluate_dataset(_numbered_events(spark, sf_dir), the_plan, "n")[0].select("rule_id", "outcome", "value", "message")


_CLICK = dsl.select("doc", "a", expected=NUMBER)
_NULLS = "CAST(NULL AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS message"
_dataset_query("ds_count", "count_of", _CLICK, "SELECT 'fold' AS rule_id, 'AGGREGATE' AS outcome, count(*) FILTER (event_type = 'click') AS value, CAST(NULL AS VARCHAR) AS message FROM events")
_dataset_query("ds_all", "all_of", _CLICK, f"SELECT 'fold' AS rule_id, CASE WHEN bool_and(event_type = 'click') THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, {_NULLS} FROM events")
_dataset_query("ds_any", "any_of", _CLICK, f"SELECT 'fold' AS rule_id, CASE WHEN bool_or(event_type = 'click') THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, {_NULLS} FROM events")
_dataset_query("ds_none", "none_of", _CLICK, f"SELECT 'fold' AS rule_id, CASE WHEN bool_or(event_type = 'click') THEN 'VIOLATED' ELSE 'PASSED' END AS outcome, {_NULLS} FROM events")
_dataset_query(
    "ds_count_cap", "count_of", _CLICK,
    "SELECT 'fold' AS rule_id, CASE WHEN c > 100 THEN 'ERROR' ELSE 'AGGREGATE' END AS outcome, CASE WHEN c > 100 THEN NULL ELSE c END AS value, CASE WHEN c > 100 THEN 'count cap 100 reached after 100' END AS message FROM (SELECT count(*) FILTER (event_type = 'click') AS c FROM events)", cap=100,
)
_dataset_query(
    "ds_fold_cap", "all_of", dsl.select("value", expected=NUMBER),
    f"SELECT 'fold' AS rule_id, CASE WHEN count(*) > 50 THEN 'ERROR' ELSE 'PASSED' END AS outcome, CAST(NULL AS BIGINT) AS value, CASE WHEN count(*) > 50 THEN 'count cap 50 reached after 50' END AS message FROM events", cap=50,
)

_TALLY_RULES = (
    dsl.rule("quantity", require=dsl.root("l_quantity").number().lte(45)),
    dsl.rule("returned", require=dsl.root("l_discount").number().lt(Decimal("0.09")), applies_when=dsl.root("l_returnflag").text().eq_text("R")),
    dsl.rule("tax", forbid=dsl.root("l_tax").number().gt(Decimal("0.07"))),
    dsl.rule("status", require=dsl.not_(dsl.root("l_linestatus").text().eq_text("X"))),
    dsl.rule("absent-optional", require=dsl.optional_root("l_comment").text().eq_text("")),
    dsl.rule("flag-as-number", require=dsl.root("l_returnflag").number().gt(0)),
)


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"))


_LINE_SQL = "(SELECT *, l_orderkey * 8 + l_linenumber AS n FROM lineitem)"
# the double next to 0.09 is below it and the one next to 0.07 above, and comparisons are exact
_TALLY_SQL = (
    "SELECT rule_id, CASE WHEN e IS NOT NULL THEN 'ERROR' WHEN v > 0 THEN 'VIOLATED' ELSE 'PASSED' END AS outcome, CASE WHEN e IS NULL THEN v ELSE 0 END AS violations, CASE WHEN e IS NULL THEN l END AS last_row, "
    "CASE WHEN e IS NOT NULL THEN 'typed refusal at row ' || e END AS message FROM ("
    f"SELECT 'quantity' AS rule_id, count(*) FILTER (l_quantity > 45) AS v, max(n) FILTER (l_quantity > 45) AS l, CAST(NULL AS BIGINT) AS e FROM {_LINE_SQL} UNION ALL "
    f"SELECT 'returned', count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.09::DOUBLE), max(n) FILTER (l_returnflag = 'R' AND l_discount > 0.09::DOUBLE), NULL FROM {_LINE_SQL} UNION ALL "
    f"SELECT 'tax', count(*) FILTER (l_tax >= 0.07::DOUBLE), max(n) FILTER (l_tax >= 0.07::DOUBLE), NULL FROM {_LINE_SQL} UNION ALL "
    f"SELECT 'status', count(*) FILTER (l_linestatus = 'X'), max(n) FILTER (l_linestatus = 'X'), NULL FROM {_LINE_SQL} UNION ALL "
    f"SELECT 'absent-optional', 0, NULL, NULL UNION ALL SELECT 'flag-as-number', 0, NULL, min(n) FROM {_LINE_SQL})"
)


@register("ds_local_tally", _TALLY_SQL)
def ds_local_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = 1 << 62  # the keys leave gaps, so the budget is none here
    outcomes, _ = dataset.evaluate_dataset(_numbered_lines(spark, sf_dir), dataset.plan(_set(*_TALLY_RULES), big), "n")
    return outcomes.select("rule_id", "outcome", "violations", "last_row", "message")


@register(
    "ds_budget_stop",
    "SELECT r.rule_id, 'ERROR' AS outcome, CASE r.rule_id WHEN 'text-number' THEN 'typed refusal at row 1' ELSE 'row_budget cap 500 reached after 500' END AS message FROM (VALUES ('value'), ('text-number'), ('any')) r(rule_id)",
)
def ds_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (dsl.rule("value", require=dsl.root("value").number().gte(0)), dsl.rule("text-number", require=dsl.root("event_type").number().gte(0)), dsl.rule("any", require=dsl.any_of(_DATA, _CLICK)))
    return dataset.evaluate_dataset(_numbered_events(spark, sf_dir), dataset.plan(_set(*rules), row_budget=500), "n")[0].select("rule_id", "outcome", "message")


@register(
    "ds_metrics",
    "SELECT least(count(*), 800) AS rows_consumed, CAST(1 + greatest(0, count(*) FILTER (event_type = 'click' AND event_id < 800) - 10) + CASE WHEN coalesce(min(event_id) FILTER (event_type = 'click'), 800) < 10 THEN 0 ELSE 790 END AS BIGINT) AS rows_refused, CAST(800 AS BIGINT) AS budget_limit, CAST(2 AS BIGINT) AS accumulators_used FROM events",
)
def ds_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (dsl.rule("count", require=dsl.count_of(_DATA, _CLICK).expression), dsl.rule("any", require=dsl.any_of(_DATA, _CLICK)), dsl.rule("value", require=dsl.root("value").number().gte(0)))
    return dataset.evaluate_dataset(_numbered_events(spark, sf_dir), dataset.plan(_set(*rules), row_budget=800, cap=10), "n")[1]


def _sum_query(name: str, source: str, column: str, scale: int) -> None:
    exact = f"CAST(sum(CAST({column} AS DECIMAL(28,{scale}))) AS VARCHAR)"
    text = f"regexp_replace(regexp_replace({exact}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')" if scale else exact

    @register(name, f"SELECT {text} AS sum_value, count(*) AS rows_summed, CAST(0 AS BIGINT) AS type_mismatches, CAST(NULL AS VARCHAR) AS refusal FROM {source}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset.sum_exact(table(spark, sf_dir, source), column, cap=1 << 62)


_sum_query("ds_sum", "lineitem", "l_extendedprice", 6)
_sum_query("ds_sum_of_integers", "orders", "o_orderkey", 0)


@register("ds_sum_refused", "SELECT CAST(NULL AS VARCHAR) AS sum_value, CAST(700 AS BIGINT) AS rows_summed, CAST(0 AS BIGINT) AS type_mismatches, 'SUM' AS refusal FROM events LIMIT 1")
def ds_sum_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sum_exact(_numbered_events(spark, sf_dir), "value", cap=700, ordinal="n")


@register(
    "ds_sum_mismatch",
    "SELECT CAST(NULL AS VARCHAR) AS sum_value, min(event_id) FILTER (event_type = 'click') AS rows_summed, count(*) FILTER (event_type = 'click') AS type_mismatches, 'TYPE_MISMATCH' AS refusal FROM events",
)
def ds_sum_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks have no finite value."""
    df = _numbered_events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value").cast("double")))
    return dataset.sum_exact(df, "value", cap=1 << 62, ordinal="n")


@register("ds_ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders")
def ds_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


def _files_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as three files, by event_id, whose rows are numbered from 1 each."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rows.select("event_type", "value", (F.col("event_id") % 3).alias("file_no"), (F.floor(F.col("event_id") / 3) + 1).alias("n"))


_FILE_SQL = "(SELECT event_type, value, event_id % 3 AS file_no, event_id // 3 + 1 AS n FROM events)"


@register(
    "ds_multi_file",
    "SELECT 'value' AS rule_id, CASE WHEN count(*) FILTER (value < 10) > 0 THEN 'VIOLATED' ELSE 'PASSED' END AS outcome, count(*) FILTER (value < 10) AS violations, "
    f"arg_max(n, (file_no, n)) FILTER (value < 10) AS last_row FROM {_FILE_SQL}",
)
def ds_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file has a budget of its own, which the largest just keeps."""
    rows = _files_of_events(spark, sf_dir)
    the_plan = dataset.plan(_set(dsl.rule("value", require=dsl.root("value").number().gte(10))), row_budget=rows.agg(F.max("n")).first()[0] or 1)
    per_file, _ = dataset.evaluate_dataset(rows, the_plan, "n", by="file_no")
    return dataset.multi_file_outcome(per_file).select("rule_id", "outcome", "violations", "last_row")


@register(
    "ds_multi_file_abort",
    f"SELECT r.rule_id, CASE r.rule_id WHEN 'value' THEN CASE WHEN count(*) FILTER (file_no < 2 AND value < 10) > 0 THEN 'VIOLATED' ELSE 'PASSED' END ELSE 'ERROR' END AS outcome, "
    "CASE r.rule_id WHEN 'value' THEN count(*) FILTER (file_no < 2 AND value < 10) ELSE 0 END AS violations, CASE r.rule_id WHEN 'typed' THEN 'typed refusal at row 4' END AS message "
    f"FROM {_FILE_SQL} CROSS JOIN (VALUES ('value'), ('typed')) r(rule_id) GROUP BY r.rule_id",
)
def ds_multi_file_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From its fourth row on the second file has no text: it is the last one that counts."""
    rows = _files_of_events(spark, sf_dir).withColumn("note", F.when((F.col("file_no") < 1) | (F.col("n") < 4), F.lit("x")))
    rules = (dsl.rule("value", require=dsl.root("value").number().gte(10)), dsl.rule("typed", require=dsl.root("note").text().eq_text("x")))
    per_file, _ = dataset.evaluate_dataset(rows, dataset.plan(_set(*rules), row_budget=1 << 62), "n", by="file_no")
    return dataset.multi_file_outcome(per_file).select("rule_id", "outcome", "violations", "message")


# governance

_AUTHORITY = Authority("security", frozenset({"PROJECT"}), "d1")
_PLATFORM = dsl.policy_set("platform", dsl.policy("spend", dsl.rule("limit", require=dsl.root("o_totalprice").number().lte(200000)), dsl.rule("status", require=dsl.not_(dsl.root("o_orderstatus").text().eq_text("P")))))
_PROJECT = dsl.policy_set("project", dsl.policy("spend", dsl.rule("priority", require=dsl.not_(dsl.root("o_orderpriority").text().eq_text("5-LOW")))))
_PROJECT_OVER = dsl.policy_set("project", dsl.policy("spend", governance.superseding(dsl.rule("limit", require=dsl.root("o_totalprice").number().lte(300000)), "spend", _AUTHORITY, "approved")))


def _layer_query(name: str, layers, authorities, limit: int, extra: str) -> None:
    @register(
        name,
        f"SELECT rule_id, outcome, count(*) AS n, min(policy_set_id) AS policy_set_id FROM (SELECT 'layered:platform+project' AS policy_set_id, 'limit' AS rule_id, CASE WHEN o_totalprice <= {limit} THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM orders "
        f"UNION ALL SELECT 'layered:platform+project', 'status', CASE WHEN o_orderstatus <> 'P' THEN 'PASSED' ELSE 'VIOLATED' END FROM orders{extra}) GROUP BY rule_id, outcome",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
        out = evaluate.evaluate(df, governance.compose(layers, authorities), "o_orderkey")
        return out.groupBy("rule_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.min("policy_set_id").alias("policy_set_id"))


_layer_query("gov_layers", [("PROJECT", _PROJECT), ("PLATFORM", _PLATFORM)], None, 200000, " UNION ALL SELECT 'layered:platform+project', 'priority', CASE WHEN o_orderpriority <> '5-LOW' THEN 'PASSED' ELSE 'VIOLATED' END FROM orders")
_layer_query("gov_supersession", [("PROJECT", _PROJECT_OVER), ("PLATFORM", _PLATFORM)], governance.Authorities(_AUTHORITY), 300000, "")

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
_day = lambda y, m, d: datetime(y, m, d, tzinfo=timezone.utc)
WAIVERS = [
    governance.Waiver("old", "p", "balance", "nation", "3", _day(2024, 1, 1), _day(2024, 12, 31)),
    governance.Waiver("shadowed", "p", "balance", "nation", "3", _day(2025, 1, 1), _day(2025, 12, 31)),
    governance.Waiver("good", "p", "balance", "nation", "5", _day(2025, 1, 1), _day(2025, 12, 31)),
    governance.Waiver("early", "p", "balance", "nation", "7", _day(2026, 1, 1), _day(2026, 12, 31)),
    governance.Waiver("scoped", "p", "balance", "nation", "9", _day(2025, 1, 1), _day(2025, 12, 31), project_scope="other"),
    governance.Waiver("fits", "p", "balance", "nation", "11", _day(2025, 1, 1), _day(2025, 12, 31), project_scope="mine"),
]
_BALANCE = dsl.rule("balance", require=dsl.root("s_acctbal").number().gte(5000))
_WAIVER_SQL = (
    "SELECT CAST(s_suppkey AS VARCHAR) AS resource_id, CASE WHEN s_acctbal >= 5000 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, CASE WHEN s_acctbal < 5000 THEN CASE s_nationkey WHEN 3 THEN 'old' WHEN 5 THEN 'good' WHEN 7 THEN 'early' WHEN 11 THEN 'fits' END END AS waiver_id, "
    "CASE WHEN s_acctbal < 5000 THEN CASE s_nationkey WHEN 3 THEN 'ACTIVE_EXPIRED' WHEN 5 THEN 'WAIVED' WHEN 7 THEN 'ACTIVE_NOT_YET_VALID' WHEN 11 THEN 'WAIVED' ELSE 'ACTIVE' END END AS waiver_state FROM supplier"
)


def _supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    out = evaluate.evaluate(df, _set(_BALANCE), "s_suppkey", keep={"nation": F.col("s_nationkey").cast("string")})
    return out.withColumn("resource_fingerprint", F.sha2("resource_id", 256))


@register("gov_waivers", _WAIVER_SQL)
def gov_waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.apply_waivers(_supplier_results(spark, sf_dir), WAIVERS, NOW, {"nation": F.col("nation")}, governance.WaiverContext(project="mine"))
    return out.select("resource_id", "outcome", "waiver_id", "waiver_state")


@register("gov_waivers_join", _WAIVER_SQL)
def gov_waivers_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.join_waivers(_supplier_results(spark, sf_dir), governance.waivers_frame(spark, WAIVERS), NOW, {"nation": F.col("nation")}, governance.WaiverContext(project="mine"))
    return out.select("resource_id", "outcome", "waiver_id", "waiver_state")


@register("gov_many_waivers", "SELECT CAST(s_suppkey AS VARCHAR) AS resource_id, CASE WHEN s_acctbal < 5000 AND s_suppkey % 2 = 1 AND s_suppkey < 1200 THEN 'w' || s_suppkey END AS waiver_id, CASE WHEN s_acctbal < 5000 THEN CASE WHEN s_suppkey % 2 = 1 AND s_suppkey < 1200 THEN 'WAIVED' ELSE 'ACTIVE' END END AS waiver_state FROM supplier")
def gov_many_waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 waivers, each for one supplier."""
    many = [governance.Waiver(f"w{i}", "p", "balance", "supplier", str(i), _day(2025, 1, 1), _day(2025, 12, 31)) for i in range(1, 1200, 2)]
    out = governance.apply_waivers(_supplier_results(spark, sf_dir), many, NOW, {"supplier": F.col("resource_id")})
    return out.select("resource_id", "waiver_id", "waiver_state")


@register(
    "gov_waiver_counts",
    "SELECT CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_nationkey IN (5, 11) THEN n ELSE 0 END AS waived, CASE WHEN s_nationkey IN (5, 11) THEN 0 ELSE n END AS active, CASE WHEN s_nationkey = 3 THEN n ELSE 0 END AS expired, "
    "CASE WHEN s_nationkey = 7 THEN n ELSE 0 END AS not_yet_valid, CAST(0 AS BIGINT) AS errors FROM (SELECT s_nationkey, count(*) FILTER (s_acctbal < 5000) AS n FROM supplier GROUP BY s_nationkey)",
)
def gov_waiver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = governance.apply_waivers(_supplier_results(spark, sf_dir), WAIVERS, NOW, {"nation": F.col("nation")}, governance.WaiverContext(project="mine"))
    return governance.waiver_counts(out, "nation")


_SEGMENT_RULES = (dsl.rule("balance", require=dsl.root("c_acctbal").number().gte(-900)), dsl.rule("nation", require=dsl.root("c_nationkey").number().lt(24)))


def _verdict_query(name: str, enforcement: str) -> None:
    @register(
        name,
        "SELECT c_mktsegment, CAST(0 AS BIGINT) AS errors, a + b AS violating_rules, CASE WHEN a + b > 0 THEN 'VIOLATED' ELSE 'PASSED' END AS verdict, "
        f"(a + b > 0) AND {str(enforcement == 'ENFORCED').lower()} AS denies, (a + b > 0) AND {str(enforcement == 'SHADOW').lower()} AS would_deny FROM (SELECT c_mktsegment, CAST(bool_or(c_acctbal < -900) AS BIGINT) AS a, CAST(bool_or(c_nationkey >= 24) AS BIGINT) AS b FROM customer GROUP BY c_mktsegment)",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
        out = evaluate.evaluate(df, _set(*_SEGMENT_RULES), "c_custkey", keep={"c_mktsegment": "c_mktsegment"})
        return governance.verdicts(out, enforcement, "c_mktsegment")


_verdict_query("gov_verdict_enforced", governance.ENFORCED)
_verdict_query("gov_verdict_shadow", governance.SHADOW)

# differences

_SIDE_A = (dsl.rule("short", require=dsl.root("n_chars").number().lte(3000)), dsl.rule("english", require=dsl.root("lang").text().eq_text("en"), severity="WARNING"), dsl.rule("gone", require=dsl.root("n_chars").number().gte(100)), dsl.rule("typed", require=dsl.root("lang").number().gt(0)))
_SIDE_B = (dsl.rule("short", require=dsl.root("n_chars").number().lte(5000)), dsl.rule("english", require=dsl.root("lang").text().eq_text("en"), severity="CRITICAL"), dsl.rule("typed", require=dsl.root("lang").text().eq_text("en")))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    made = [evaluate.evaluate(df, _set(*rules), "doc_id", keep={"doc_lang": "lang"}).withColumn("resource_fingerprint", F.sha2("resource_id", 256)) for rules in (_SIDE_A, _SIDE_B)]
    return made[0], made[1]


_DIFF_SQL = (
    "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars, lang FROM documents), e AS ("
    "SELECT id, 'short' AS rule_id, 'n_chars' AS loc, CASE WHEN n_chars > 3000 AND n_chars <= 5000 THEN 'RESOLVED_VIOLATION' END AS category FROM d UNION ALL "
    "SELECT id, 'english', CASE WHEN lang = 'en' THEN 'root' ELSE 'lang' END, 'SEVERITY_CHANGED' FROM d UNION ALL "
    "SELECT id, 'gone', CASE WHEN n_chars >= 100 THEN 'root' ELSE 'n_chars' END, CASE WHEN n_chars >= 100 THEN 'APPLICABILITY_CHANGED' ELSE 'RESOLVED_VIOLATION' END FROM d UNION ALL "
    "SELECT id, 'typed', 'lang', 'ERROR_RESOLVED' FROM d) "
    "SELECT id AS resource_id, rule_id, category, sha256('1:s1:p' || length(rule_id) || ':' || rule_id || length(loc) || ':' || loc || '64:' || sha256(id)) AS fingerprint, category = 'RESOLVED_VIOLATION' AS privilege_expansion FROM e WHERE category IS NOT NULL"
)


@register("diff_reports", _DIFF_SQL)
def diff_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return governance.diff_reports(a, b).select("resource_id", "rule_id", "category", "fingerprint", "privilege_expansion")


@register(
    "diff_waiver_effect",
    "SELECT CAST(doc_id AS VARCHAR) AS resource_id, 'short' AS rule_id, CASE WHEN n_chars > 5000 THEN 'WAIVER_EFFECT_CHANGED' ELSE 'NEW_VIOLATION' END AS category FROM documents WHERE FALSE UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 'short', CASE WHEN n_chars > 5000 THEN 'WAIVER_EFFECT_CHANGED' ELSE 'RESOLVED_VIOLATION' END FROM documents WHERE (lang = 'en' AND n_chars > 5000) OR (n_chars > 3000 AND n_chars <= 5000 AND lang <> 'en')",
)
def diff_waiver_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of English documents are waived on the first side only."""
    a, b = (x.where("rule_id = 'short'") for x in _sides(spark, sf_dir))
    a = a.withColumn("waiver_state", F.when(F.col("outcome") == "VIOLATED", F.when(F.col("doc_lang") == "en", "WAIVED").otherwise("ACTIVE")))
    b = b.withColumn("waiver_state", F.when(F.col("outcome") == "VIOLATED", "ACTIVE"))
    return governance.diff_reports(a, b, waived=True).select("resource_id", "rule_id", "category")


@register(
    "diff_corpora",
    "SELECT CAST(doc_id AS VARCHAR) AS resource_id, 'short' AS rule_id, 'RESOLVED_VIOLATION' AS category FROM documents WHERE n_chars > 3000 AND n_chars <= 5000 AND doc_id % 5 <> 0 "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'CORPUS_MISMATCH' FROM documents WHERE doc_id % 5 = 0",
)
def diff_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is another one on the second side."""
    a, b = (x.where("rule_id = 'short'") for x in _sides(spark, sf_dir))
    changed = F.when(F.col("resource_id").cast("long") % 5 == 0, F.lit("changed")).otherwise(F.col("resource_fingerprint"))
    return governance.diff_reports(a, b.withColumn("resource_fingerprint", changed)).select("resource_id", "rule_id", "category")


_ENTRY_SQL = "length(category) || ':' || category || length(fingerprint) || ':' || fingerprint || length(k) || ':' || k || length(x) || ':' || x"


@register(
    "diff_digest",
    "SELECT resource_id, sha256(count(*) || ':' || string_agg(" + _ENTRY_SQL + ", '' ORDER BY category, fingerprint, k)) AS diff_digest FROM (SELECT resource_id, category, fingerprint, "
    "'1:s1:p' || length(rule_id) || ':' || rule_id AS k, CAST(privilege_expansion AS VARCHAR) AS x FROM (" + _DIFF_SQL + ")) GROUP BY resource_id",
)
def diff_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return governance.diff_digest(governance.diff_reports(a, b), "resource_id")


# digests

_ORDER_COLUMNS = ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
_ORDER_ROW = (
    "'{\"o_custkey\":{\"type\":\"number\",\"v\":' || o_custkey || '}, \"o_orderkey\":{\"type\":\"number\",\"v\":' || o_orderkey || '}, "
    "\"o_orderpriority\":{\"type\":\"text\",\"v\":\"' || o_orderpriority || '\"}, \"o_orderstatus\":{\"type\":\"text\",\"v\":\"' || o_orderstatus || '\"}}'"
)


@register("fingerprints", f"SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, sha256({_ORDER_ROW}) AS resource_fingerprint FROM orders")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    return df.select(F.col("o_orderkey").cast("string").alias("resource_id"), evaluate.row_fingerprint(df).alias("resource_fingerprint"))


# two rules, of which the key of the second sorts first: 1:s1:p3:abc and 1:s1:p4:cust
_DIGEST_RULES = (dsl.rule("cust", require=dsl.root("o_custkey").number().lte(700)), dsl.rule("abc", require=dsl.root("o_orderstatus").text().eq_text("O")))
_DIGEST_SQL = (
    "WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS st, sha256(" + _ORDER_ROW + ") AS fp, o_custkey FROM orders), t AS (SELECT id, fp, "
    "CASE WHEN o_custkey <= 700 THEN 'passed' ELSE 'violated1:17:COMPARISON_FAILED9:o_custkey4:cust5:<=700' || length(c) || ':' || c END AS cust, "
    "CASE WHEN st = 'O' THEN 'passed' ELSE 'violated1:17:COMPARISON_FAILED13:o_orderstatus3:abc7:==textO' || length(st) || ':' || st END AS abc FROM r) "
    "SELECT id AS resource_id, sha256('1:s64:' || fp || '2:' || '11:1:s1:p3:abc' || length(abc) || ':' || abc || '12:1:s1:p4:cust' || length(cust) || ':' || cust) AS report_digest FROM t"
)


@register("report_digest", _DIGEST_SQL)
def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    return evaluate.report_digests(df, _set(*_DIGEST_RULES), "o_orderkey", evaluate.row_fingerprint(df))


@register("report_digest_of_results", _DIGEST_SQL)
def report_digest_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from long results, gathered by resource."""
    df = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    return evaluate.report_digest(evaluate.evaluate(df, _set(*_DIGEST_RULES), "o_orderkey", keep={"resource_fingerprint": evaluate.row_fingerprint(df)}))


# findings


@register(
    "findings_dedup",
    "SELECT 'url' AS rule_id, resource_id, 'violation' AS state, 'page_id' AS path, min_by(actual, page_id) AS actual, 'url' AS remediation FROM (SELECT page_id, CAST(page_id % 7 AS VARCHAR) AS resource_id, CAST(page_id AS VARCHAR) AS actual FROM pages WHERE page_id >= 20) GROUP BY resource_id",
)
def findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id")
    out = evaluate.evaluate(df, _set(dsl.rule("url", require=dsl.root("page_id").number().lt(20))), (F.col("page_id") % 7).cast("string"), keep={"page": "page_id"})
    return findings.findings(out.withColumn("resource_fingerprint", F.lit("f")), F.col("page")).select("rule_id", "resource_id", "state", "path", "actual", "remediation")


@register(
    "findings_events",
    "SELECT resource_id, 'v1' || chr(31) || CASE WHEN n > 0 THEN 'VIOLATED' ELSE 'PASSED' END || chr(31) || n || chr(31) || report_digest || chr(31) || 's' || chr(31) || 'SHADOW' || chr(31) || CASE WHEN n > 0 THEN 'true' ELSE 'false' END AS event "
    "FROM (" + _DIGEST_SQL + ") JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey > 700 AS INT) + CAST(o_orderstatus <> 'O' AS INT) AS n FROM orders) USING (resource_id)",
)
def findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each order's check: its verdict, its violating rules and the digest of its report."""
    df, rules = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), _set(*_DIGEST_RULES)
    decided = governance.verdicts(evaluate.evaluate(df, rules, "o_orderkey"), governance.SHADOW, "resource_id")
    checked = decided.join(evaluate.report_digests(df, rules, "o_orderkey", evaluate.row_fingerprint(df)), "resource_id")
    return checked.select("resource_id", findings.event_column(F.col("verdict"), F.col("violating_rules"), F.col("report_digest"), F.lit("s"), F.lit(governance.SHADOW), F.col("would_deny")).alias("event"))


# sources


def _scan_query(name: str, kind: str) -> None:
    @register(name, "SELECT count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS ids, count(*) FILTER (event_type = 'click') AS clicks, CAST(0 AS BIGINT) AS refusals FROM events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from verdictframe.sources import readers

        path = fresh_path(spark, name)
        df = table(spark, sf_dir, "events").select("event_id", "event_type")
        df.write.option("header", True).format("csv" if kind == "CSV" else "json").save(path)
        rows = readers.read_rows(spark, f"{path}/part-*", kind=kind).withColumn("v", F.try_parse_json("row"))
        get = lambda c, t: F.try_variant_get("v", f"$.{c}", t)
        return rows.agg(F.count("row").alias("n_rows"), F.sum(get("event_id", "string").cast("long")).alias("ids"), F.count_if(get("event_type", "string") == "click").alias("clicks"), F.count("refusal").alias("refusals"))


_scan_query("scan_csv", "CSV")
_scan_query("scan_jsonl", "JSONL")


@register("scan_documents", "SELECT CAST(n_nationkey AS VARCHAR) AS resource_id, CASE WHEN n_regionkey >= 1 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM nation")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents, one file each, read back, decoded and evaluated as VARIANT."""
    from verdictframe.sources import readers

    path = fresh_path(spark, "documents")
    nation = table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", F.struct("n_regionkey").alias("spec"))).alias("value"))
    nation.repartitionByRange(25, "value").write.option("maxRecordsPerFile", 1).format("text").save(path)
    docs = readers.read_documents(spark, f"{path}/part-*", kind="JSON").where("refusal is null").select(F.parse_json("doc").alias("doc"))
    rule = dsl.rule("region", require=dsl.root("spec").field("n_regionkey").number().gte(1))
    name = F.variant_get("doc", "$.n_nationkey", "string")
    return evaluate.evaluate(docs, _set(rule), name, document="doc").select("resource_id", "outcome")


def _written(spark: SparkSession, name: str, lines: DataFrame) -> str:
    """A path of text files with these values as their lines."""
    path = fresh_path(spark, name)
    lines.write.format("text").save(path)
    return f"{path}/part-*"


@register("scan_csv_cells", "SELECT count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(doc_id) AS BIGINT) AS last_id, CAST(0 AS BIGINT) AS refusals FROM documents")
def scan_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells with commas, quotes and line ends, read in splits that begin anywhere."""
    from verdictframe.sources import readers

    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    body = table(spark, sf_dir, "documents").sort("doc_id").coalesce(1).select(F.concat(F.when(F.col("doc_id") == 0, F.lit("doc_id,text\n")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(","), quoted).alias("value"))
    path = _written(spark, "scan_csv_cells", body)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, 300_000)
    try:
        rows = readers.read_rows(spark, path, kind="CSV").withColumn("v", F.parse_json("row"))
        get = lambda c: F.variant_get("v", f"$.{c}", "string")
        out = rows.agg(F.count("row").alias("n_rows"), F.sum(get("doc_id").cast("long")).alias("ids"), F.sum(F.length(get("text"))).cast("long").alias("chars"), F.max(get("doc_id").cast("long")).alias("last_id"), F.count("refusal").alias("refusals"))
        return out
    finally:
        spark.conf.set(name, before)


@register("scan_jsonl_refused", "SELECT min(event_id) + 1 AS row_no, 'MALFORMED' AS refusal, 'jsonl://line-' || (min(event_id) + 1) || '/not-an-object' AS anchor, CAST(min(event_id) AS BIGINT) AS rows_before FROM events WHERE event_type = 'purchase' AND event_id > 100")
def scan_jsonl_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that is no object ends its file."""
    from verdictframe.sources import readers

    bad = (F.col("event_type") == "purchase") & (F.col("event_id") > 100)
    lines = table(spark, sf_dir, "events").sort("event_id").coalesce(1).select(F.when(bad, F.lit("[1]")).otherwise(F.to_json(F.struct("event_id"))).alias("value"))
    rows = readers.read_rows(spark, _written(spark, "scan_jsonl_refused", lines), kind="JSONL")
    return rows.agg(F.max(F.when(F.col("refusal").isNotNull(), F.col("row_no"))).alias("row_no"), F.max("refusal").alias("refusal"), F.max("anchor").alias("anchor"), F.count("row").alias("rows_before"))


_SUPPLIER_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS resource_id, CASE WHEN s_nationkey >= 5 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, CASE WHEN s_nationkey < 5 THEN 'spec.nation' END AS location FROM supplier"


@register("scan_yaml", _SUPPLIER_SQL)
def scan_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML streams of many documents."""
    from verdictframe.sources import readers

    line = F.concat(F.lit("---\nkey: "), F.col("s_suppkey").cast("string"), F.lit("\nspec: {nation: "), F.col("s_nationkey").cast("string"), F.lit("}"))
    docs = readers.read_documents(spark, _written(spark, "scan_yaml", table(spark, sf_dir, "supplier").repartition(4, "s_suppkey").select(line.alias("value"))), kind="YAML")
    docs = docs.where("refusal is null").select(F.parse_json("doc").alias("doc"))
    rule = dsl.rule("nation", require=dsl.root("spec").field("nation").number().gte(5))
    return evaluate.evaluate(docs, _set(rule), F.variant_get("doc", "$.key", "string"), document="doc").select("resource_id", "outcome", "location")


@register("scan_csv_each_row", "SELECT CAST(s_suppkey AS VARCHAR) AS resource_id, CASE WHEN s_nationkey = 5 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, CASE WHEN s_nationkey <> 5 THEN CAST(s_nationkey AS VARCHAR) END AS actual FROM supplier")
def scan_csv_each_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a CSV document is a document of its own; cells are text."""
    from verdictframe.sources import readers

    path = fresh_path(spark, "scan_csv_each_row")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").repartition(3, "s_suppkey").write.option("header", True).csv(path)
    docs = readers.read_documents(spark, f"{path}/part-*", kind="CSV", each_row=True).where("refusal is null").select(F.parse_json("doc").alias("doc"))
    rule = dsl.rule("nation", require=dsl.root("s_nationkey").text().eq_text("5"))
    return evaluate.evaluate(docs, _set(rule), F.variant_get("doc", "$.s_suppkey", "string"), document="doc").select("resource_id", "outcome", "actual")


def _region_files(spark: SparkSession, sf_dir: str, name: str, lines) -> str:
    """A path with a file for each region, of the lines that `lines` makes of it."""
    regions = table(spark, sf_dir, "region").select(lines.alias("value"), "r_regionkey")
    path = fresh_path(spark, name)
    regions.repartitionByRange(5, "r_regionkey").select("value").write.option("maxRecordsPerFile", 1).format("text").save(path)
    return f"{path}/part-*"


@register("scan_csv_document", "SELECT CAST(r_regionkey AS VARCHAR) AS region, CASE WHEN r_regionkey < 3 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM region")
def scan_csv_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file as one document, a sequence of rows of which ALL must have a cell of the region's key or less."""
    from verdictframe.sources import readers

    key = F.col("r_regionkey").cast("string")
    odd = F.when(F.col("r_regionkey") >= 3, F.lit("y")).otherwise(F.lit("x"))
    docs = readers.read_documents(spark, _region_files(spark, sf_dir, "scan_csv_document", F.concat(F.lit("key,flag\n"), key, F.lit(",x\n"), key, F.lit(","), odd)), kind="CSV").where("refusal is null")
    docs = docs.select(F.parse_json(F.concat(F.lit('{"rows":'), F.col("doc"), F.lit("}"))).alias("doc"))
    flagged = F.expr("forall(variant_get(doc, '$.rows', 'array<variant>'), r -> variant_get(r, '$.flag', 'string') = 'x')")
    made = docs.select(F.variant_get("doc", "$.rows[0].key", "string").alias("region"), flagged.alias("flagged"))
    return evaluate.evaluate(made, _set(dsl.rule("all", require=dsl.root("flagged").boolean().eq_bool(True))), "region").select(F.col("resource_id").alias("region"), "outcome")


@register("scan_csv_frozen", "SELECT count(*) FILTER (r_regionkey < 2) AS read, count(*) FILTER (r_regionkey >= 2) AS refused, 'SCHEMA_FROZEN' AS refusal, 'cell(4,1)' AS anchor FROM region")
def scan_csv_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds are frozen from the first two rows; a later cell that breaks them refuses its file, with its place."""
    from verdictframe.sources import readers

    last = F.when(F.col("r_regionkey") < 2, F.lit("7")).otherwise(F.lit("seven"))
    docs = readers.read_documents(spark, _region_files(spark, sf_dir, "scan_csv_frozen", F.concat(F.lit("n,t\n1,a\n2,b\n"), last, F.lit(",c"))), kind="CSV", infer_sample=2)
    return docs.agg(F.count("doc").alias("read"), F.count("refusal").alias("refused"), F.max("refusal").alias("refusal"), F.max("anchor").alias("anchor"))


@register("scan_refusals", "SELECT CASE WHEN r_regionkey = 1 THEN 'DUPLICATE_KEY' WHEN r_regionkey = 2 THEN 'MALFORMED' ELSE 'READ' END AS state, count(*) AS n FROM region GROUP BY 1")
def scan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of which one repeats a key and one is cut short."""
    from verdictframe.sources import readers

    text = F.when(F.col("r_regionkey") == 1, F.lit('{"a": 1, "a": 2}')).when(F.col("r_regionkey") == 2, F.lit('{"a": ')).otherwise(F.concat(F.lit('{"a": '), F.col("r_regionkey").cast("string"), F.lit("}")))
    docs = readers.read_documents(spark, _region_files(spark, sf_dir, "scan_refusals", text), kind="JSON")
    return docs.groupBy(F.coalesce("refusal", F.lit("READ")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("scan_host_maps", "SELECT r_name AS resource_id, CASE WHEN r_regionkey >= 2 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome FROM region")
def scan_host_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdictframe.sources import readers

    host = {r.r_name: {"key": r.r_regionkey, "names": [r.r_name], "none": None} for r in table(spark, sf_dir, "region").collect()}
    docs = readers.from_host(spark, host).select("resource_id", F.parse_json("doc").alias("doc"))
    return evaluate.evaluate(docs, _set(dsl.rule("key", require=dsl.root("key").number().gte(2))), "resource_id", document="doc").select("resource_id", "outcome")


@register("bundle_rules", "SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CASE WHEN o_orderstatus = 'O' THEN 'PASSED' ELSE 'VIOLATED' END AS abc, CASE WHEN o_custkey <= 700 THEN 'PASSED' ELSE 'VIOLATED' END AS cust FROM orders")
def bundle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that were lowered, packed as a bundle, verified and read back."""
    from verdictframe.plans import codec

    document = codec.unpack(codec.pack(codec.lower(_set(*_DIGEST_RULES))))[0]
    out = evaluate.evaluate(table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), document.policies, "o_orderkey")
    return out.groupBy("resource_id").agg(F.max(F.when(F.col("rule_id") == "abc", F.col("outcome"))).alias("abc"), F.max(F.when(F.col("rule_id") == "cust", F.col("outcome"))).alias("cust"))


@register("rule_field_as_boolean", "SELECT CAST(doc_id AS VARCHAR) AS resource_id, 'ERROR' AS outcome, 'TYPE_MISMATCH' AS code FROM labels")
def rule_field_as_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field is no condition on its own, even if it is a boolean."""
    df = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    return evaluate.evaluate(df, _set(dsl.rule("toxic", require=dsl.root("toxic").boolean().expression)), "doc_id").select("resource_id", "outcome", "code")


@register(
    "scan_admission",
    "SELECT admission, count(*) AS n FROM (SELECT CASE WHEN length(to_base64(encode(text))) > 2668 THEN 'TOO_LARGE' WHEN strlen(text) > 2000 THEN 'TOO_LARGE' ELSE 'OK' END AS admission FROM documents) GROUP BY admission",
)
def scan_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdictframe.sources import readers

    df = table(spark, sf_dir, "documents").select(F.base64(F.encode("text", "utf-8")).alias("payload64"))
    return readers.admit_encoded(df.select(F.replace("payload64", F.lit("\r\n"), F.lit("")).alias("payload64")), "payload64", 2000).groupBy("admission").agg(F.count(F.lit(1)).alias("n"))


# extensions


@register("cross_any", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def cross_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey")
    return crossref.related(table(spark, sf_dir, "customer").select("c_custkey"), orders, F.col("c_custkey") == F.col("o_custkey"), "ANY", requires_global_index=True)


@register(
    "ds_tally_by_group",
    "SELECT l_returnflag, 'quantity' AS rule_id, count(*) FILTER (l_quantity <= 45) AS passed, count(*) FILTER (l_quantity > 45) AS violated, CAST(0 AS BIGINT) AS not_applicable, CAST(0 AS BIGINT) AS errors FROM lineitem GROUP BY l_returnflag",
)
def ds_tally_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossref.tally_by(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), _set(_TALLY_RULES[0]), "l_returnflag")


@register(
    "stream_windows",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, 'value' AS rule_id, CASE WHEN value >= 10 THEN 'PASSED' ELSE 'VIOLATED' END AS outcome, count(*) AS n FROM events GROUP BY 1, 3",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_outcomes(table(spark, sf_dir, "events").select("ts", "value"), _set(dsl.rule("value", require=dsl.root("value").number().gte(10))), "ts")
