"""Rules over the rows of a data set: one report row for each resource and rule, fingerprints and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.storage import free_names
from verdictframe.operators.compiler import Compiler
from verdictframe.plans.ir import PolicySet, Rule

RESULT = ("outcome", "code", "location", "message", "expected", "actual")


def _results(df: DataFrame, policies: PolicySet, document: str | None) -> tuple[DataFrame, list[tuple[str, Rule, str]]]:
    """`df` with a column for each rule's result, and (policy id, rule, name of that column) of all rules.

    The states come first, each in a column of its own: a rule's result reads them several times.
    """
    compiler, rules = Compiler(df.schema, document), list(policies.rules())
    df, places = compiler.project(df, *[e for _, r in rules for e in (r.expression, r.applies_when)])
    names = free_names(df.columns, *[f"{kind}_{i}" for i in range(len(rules)) for kind in ("body", "gate", "result")])
    states, results, out = {}, {}, []
    for (policy_id, r), body, gate, result in zip(rules, names[::3], names[1::3], names[2::3]):
        states[body] = compiler.boolean(r.expression)
        if r.applies_when is not None:
            states[gate] = compiler.boolean(r.applies_when)
        results[result] = compiler.rule(r, F.col(body), None if r.applies_when is None else F.col(gate))
        out.append((policy_id, r, result))
    return df.withColumns(states).withColumns(results).drop(*states, *places), out


def evaluate(df: DataFrame, policies: PolicySet, resource: str | Column, document: str | None = None, keep: dict[str, str | Column] | None = None) -> DataFrame:
    """Long results: resource_id, policy_set_id, policy_id, rule_id, severity, outcome, code, location, message, expected, actual.

    All rules of a row are evaluated in one projection and unpivoted; nothing is shuffled. `document` names a VARIANT column to evaluate
    instead of the row. `keep` gives names to columns of the row that each of its results has too.
    """
    keep = keep or {}
    made, rules = _results(df, policies, document)
    rows = [F.struct(F.lit(policies.id).alias("policy_set_id"), F.lit(p).alias("policy_id"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).cast("string").alias("severity"), F.col(c).alias("r")) for p, r, c in rules]
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    long = made.select(as_column(resource).cast("string").alias("resource_id"), F.named_struct(F.lit("no"), F.lit(0), *[x for n, c in keep.items() for x in (F.lit(n), as_column(c))]).alias("kept"), F.explode(F.array(*rows)).alias("x"))
    return long.select("resource_id", "x.policy_set_id", "x.policy_id", "x.rule_id", "x.severity", *[F.col(f"x.r.{c}").alias(c) for c in RESULT], *[F.col("kept")[n].alias(n) for n in keep])


def report_digests(df: DataFrame, policies: PolicySet, resource: str | Column, fingerprint: Column, document: str | None = None) -> DataFrame:
    """resource_id, report_digest of every row: report_digest without a shuffle, since all results of a row are at hand."""
    made, rules = _results(df.withColumn((mark := free_names(df.columns, "row_fingerprint")[0]), fingerprint), policies, document)
    parts = []
    for policy_id, r, c in sorted(rules, key=lambda x: (encoded(policies.id) + encoded(x[0]) + encoded(x[1].id)).encode()):
        key = encoded(policies.id) + encoded(policy_id) + encoded(r.id)
        get = lambda f, c=c: F.col(c)[f]
        parts += [F.lit(encoded(key)), encode_parts(_result_text(get))]
    body = F.concat(F.lit(encoded(policies.id)), encode_parts(F.col(mark)), F.lit(f"{len(rules)}:"), *parts)
    return made.select((F.col(resource) if isinstance(resource, str) else resource).cast("string").alias("resource_id"), F.sha2(body, 256).alias("report_digest"))


def encoded(text: str) -> str:
    """encode_parts of a known text."""
    return f"{len(text.encode('utf-16-be')) // 2}:{text}"


def _result_text(get) -> Column:
    parts = F.concat(F.lit("1:"), encode_parts(*[get(c) for c in RESULT[1:]]))
    return F.when(get("outcome") == "PASSED", "passed").when(get("outcome") == "NOT_APPLICABLE", "not-applicable").otherwise(F.concat(F.when(get("outcome") == "VIOLATED", "violated").otherwise("error"), parts))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.coalesce(F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")), F.lit(0))


def encode_parts(*parts: Column) -> Column:
    """Each part with its length before it; null is -1."""
    return F.concat(*[F.coalesce(F.concat(utf16_length(p).cast("string"), F.lit(":"), p), F.lit("-1:")) for p in parts])


def violation_fingerprint(set_id: Column, policy_id: Column, rule_id: Column, location: Column, resource_fingerprint: Column) -> Column:
    return F.sha2(encode_parts(set_id, policy_id, rule_id, location, resource_fingerprint), 256)


def _escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_row(df: DataFrame) -> Column:
    """The canonical text of a row of text, number and boolean columns: a mapping by column name."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name.encode("utf-16-be")):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        name = f.name.replace("\\", "\\\\").replace('"', '\\"')
        body = F.concat(F.lit('{"type":"text","v":"'), _escaped(c), F.lit('"}')) if kind == "string" else F.concat(F.lit(f'{{"type":"{"boolean" if kind == "boolean" else "number"}","v":'), c.cast("string"), F.lit("}"))
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(body, F.lit('{"type":"null"}'))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def row_fingerprint(df: DataFrame) -> Column:
    return F.sha2(canonical_row(df), 256)


def report_digest(results: DataFrame, fingerprint: str = "resource_fingerprint") -> DataFrame:
    """resource_id, report_digest of evaluated rows with a fingerprint column: SHA-256 over the sorted results of each resource.

    A resource's results are gathered in one group, as many as there are rules.
    """
    key = encode_parts(F.col("policy_set_id"), F.col("policy_id"), F.col("rule_id"))
    text = _result_text(F.col)
    each = results.select("resource_id", "policy_set_id", fingerprint, key.alias("k"), encode_parts(key, text).alias("t"))
    grouped = each.groupBy("resource_id", "policy_set_id", fingerprint).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("x"))
    body = F.concat(encode_parts(F.col("policy_set_id"), F.col(fingerprint)), F.size("x").cast("string"), F.lit(":"), F.array_join(F.col("x.t"), ""))
    return grouped.select("resource_id", F.sha2(body, 256).alias("report_digest"))
