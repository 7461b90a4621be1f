"""Files as data frames: documents with refusals as rows, and row streams for dataset evaluation."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.plans.ir import Refusal
from verdictframe.sources import decoders
from verdictframe.sources.splits import read_rows

__all__ = ["admit_encoded", "check_budget", "encode_payload", "fast_csv", "fast_jsonl", "from_host", "read_documents", "read_rows"]

#: Bytes that a resource may have, by default and at most; fixed values.
DEFAULT_BUDGET, BUDGET_CEILING = 64 << 20, 256 << 20
DOCUMENTS = "path string, resource_id string, format string, doc string, fingerprint string, refusal string, anchor string"


def check_budget(budget: int) -> int:
    if not 0 < budget <= BUDGET_CEILING:
        raise Refusal("BUDGET", f"a resource budget lies between 1 and {BUDGET_CEILING} bytes")
    return budget


def read_documents(spark: SparkSession, path: str | list[str], *, budget: int = DEFAULT_BUDGET, each_row: bool = False, infer_sample: int = 0, kind: str | None = None) -> DataFrame:
    """DOCUMENTS: the documents of JSON, YAML and CSV files, or a row with a refusal for what can't be read.

    `doc` is JSON text that keeps numbers as written; parse_json makes it a VARIANT. Files above the budget are refused by their length,
    before their content is looked at. The format is that of the extension unless `kind` names it.
    """
    from verdictframe.functions.interpreter import digest_of

    check_budget(budget)
    files = spark.read.format("binaryFile").load(path)
    too_long = files.where(F.col("length") > budget).select("path", F.col("path").alias("resource_id"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("fingerprint"), F.lit(decoders.TOO_LARGE).alias("refusal"), F.lit(None).cast("string").alias("anchor"))

    def run(frames):
        for pdf in frames:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                form = kind
                try:
                    form = form or decoders.format_of(p)
                    options = {"each_row": each_row, "infer_sample": infer_sample} if form == "CSV" else {}
                    out += [(p, d.id, form, decoders.to_json(d.root), digest_of(d.root), None, None) for d in decoders.decode(bytes(raw), form, **options)]
                except decoders.DecodeRefusal as e:
                    out.append((p, p, form, None, None, e.code, e.anchor))
            yield pd.DataFrame(out, columns=["path", "resource_id", "format", "doc", "fingerprint", "refusal", "anchor"])

    return files.where(F.col("length") <= budget).select("path", "content").mapInPandas(run, DOCUMENTS).unionByName(too_long)


def fast_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Splittable CSV for rectangular files with unique headers: all columns text, ragged rows fail, empty cells are empty text."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"', mode="FAILFAST", enforceSchema=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def fast_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Splittable JSON lines as a VARIANT column `row`; lines that can't be parsed have null there."""
    return spark.read.text(path).where(F.length(F.replace("value", F.lit("\r"), F.lit(""))) > 0).select(F.try_parse_json("value").alias("row"))


def admit_encoded(df: DataFrame, column: str, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """`df` plus `admission` (OK, TOO_LARGE, MALFORMED) and `payload`, of base64 text: its length first, then the decoding, then the size."""
    limit = check_budget(budget)
    text = F.col(column)
    raw = F.try_to_binary(text, F.lit("base64"))
    too_long = F.length(text) > -(-limit // 3) * 4
    out = df.withColumn("_raw", F.when(~too_long, raw))
    state = F.when(text.isNull(), "MALFORMED").when(too_long, "TOO_LARGE").when(F.col("_raw").isNull(), "MALFORMED").when(F.octet_length("_raw") > limit, "TOO_LARGE").otherwise("OK")
    return out.withColumn("admission", state).withColumn("payload", F.when(F.col("admission") == "OK", F.col("_raw"))).drop("_raw")


def from_host(spark: SparkSession, resources: dict[str, object]) -> DataFrame:
    """DOCUMENTS of Python values by resource id."""
    from verdictframe.functions.interpreter import digest_of

    rows = []
    for name, host in resources.items():
        try:
            d = decoders.decode_map(host)
            rows.append((name, name, "MAP_ADAPTER", decoders.to_json(d.root), digest_of(d.root), None, None))
        except decoders.DecodeRefusal as e:
            rows.append((name, name, "MAP_ADAPTER", None, None, e.code, e.anchor))
    return spark.createDataFrame(rows, DOCUMENTS)


def encode_payload(raw: bytes) -> str:
    return base64.b64encode(raw).decode()
