"""Row rules over unbounded streams: the same compiled columns, tallied by time window behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.compiler import Compiler
from verdictframe.plans.ir import PolicySet, Refusal
from verdictframe.operators.dataset import LOCAL, rule_shape


def stream_outcomes(events: DataFrame, policies: PolicySet, time: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, rule_id, outcome, n for a stream (or a table) with a time column. Rules that need more than their row are refused."""
    if odd := [r.id for _, r in policies.rules() if rule_shape(r) != LOCAL]:
        raise Refusal("NOT_LOCAL", f"only row rules run on streams: {', '.join(odd)}")
    compiler = Compiler(events.schema)
    marks = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), compiler.outcome(r).alias("outcome")) for _, r in policies.rules()])
    marked = events.withWatermark(time, late).select(F.col(time), F.explode(marks).alias("m"))
    counted = marked.groupBy(F.window(time, window), "m.rule_id", "m.outcome").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "rule_id", "outcome", "n")
