"""Rules across data sets and by group: extensions that the planner refuses unless they are asked for by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.compiler import Compiler
from verdictframe.plans.ir import PolicySet, Refusal


def related(df: DataFrame, other: DataFrame, on: Column, op: str, *, requires_global_index: bool = False) -> DataFrame:
    """Rows of `df` that violate ANY (no row of `other` fits), NONE (some row fits); as semi and anti joins."""
    if not requires_global_index:
        raise Refusal("GLOBAL_ACCESS", "access to another data set needs requires_global_index=True")
    if op not in ("ANY", "NONE"):
        raise Refusal("GLOBAL_ACCESS", "only ANY and NONE relate two data sets")
    return df.join(other, on, "left_anti" if op == "ANY" else "left_semi")


def tally_by(df: DataFrame, policies: PolicySet, *keys: str) -> DataFrame:
    """keys, rule_id, passed, violated, not_applicable, errors: outcomes of row rules for each group, in one aggregate without an explode of rows."""
    compiler = Compiler(df.schema)
    rules = policies.rules()
    marked = df.select(*keys, *[compiler.outcome(r).alias(f"_o{i}") for i, (_, r) in enumerate(rules)])
    names = (("passed", "PASSED"), ("violated", "VIOLATED"), ("not_applicable", "NOT_APPLICABLE"), ("errors", "ERROR"))
    wide = marked.groupBy(*keys).agg(*[F.count_if(F.col(f"_o{i}") == what).alias(f"_{n}{i}") for i in range(len(rules)) for n, what in names])
    rows = [F.struct(F.lit(r.id).alias("rule_id"), *[F.col(f"_{n}{i}").alias(n) for n, _ in names]) for i, (_, r) in enumerate(rules)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")
