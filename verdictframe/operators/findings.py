"""Findings: what a check found, as rows, text, JSON and events."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.evaluate import violation_fingerprint
from verdictframe.operators.governance import first_of
from verdictframe.plans.codec import quote

#: Exit codes; fixed values.
OK, USAGE, VIOLATIONS, EVALUATION_ERROR, ADMISSION_ERROR, COMPILER_ERROR = 0, 1, 2, 3, 4, 5
SEPARATOR = "\u001f"
KEY = ["policy_id", "rule_id", "resource_id", "fingerprint", "state"]


def findings(results: DataFrame, order: Column) -> DataFrame:
    """A finding for each violation and error of evaluated rows with resource_fingerprint, the first of each key by `order`.

    The severity is always "error", whatever the rule declares.
    """
    broken = results.where(F.col("outcome").isin("VIOLATED", "ERROR"))
    location = F.coalesce("location", F.lit(""))
    fp = violation_fingerprint(F.col("policy_set_id"), F.col("policy_id"), F.col("rule_id"), location, F.col("resource_fingerprint"))
    hint = F.when(F.trim("message") == "", F.concat(F.lit("fix resource to satisfy rule "), F.col("rule_id"))).otherwise(F.col("message"))
    rows = broken.select(
        "policy_id", "rule_id", "resource_id", fp.alias("fingerprint"), F.when(F.col("outcome") == "VIOLATED", "violation").otherwise("error").alias("state"), "policy_set_id",
        F.lit("error").alias("severity"), location.alias("path"), "actual", "expected", "message", hint.alias("remediation"), order.alias("_order"),
    )
    return first_of(rows, KEY, "_order").drop("_order")


def to_jsonl(found: DataFrame, bundle_digest: str | None = None, source: str | None = None) -> DataFrame:
    """`value`: a JSON object for each finding, with the fields of Finding in their order. Rows of a table have no anchor in their source."""
    none = F.lit(None).cast("string")
    fields = {
        "violationId": "fingerprint", "policyId": "policy_id", "policySetId": "policy_set_id", "ruleId": "rule_id", "bundleDigest": F.lit(bundle_digest).cast("string"), "subjectRef": "resource_id",
        "sourceAnchor": none, "path": "path", "actual": "actual", "expected": "expected", "message": "message", "remediation": "remediation", "severity": "severity", "state": "state",
        "resourceId": "resource_id", "fingerprint": "fingerprint", "location": F.struct((F.lit(source) if source else F.col("resource_id")).alias("path")),
    }
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]
    return found.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


@dataclass(frozen=True)
class Finding:
    """A finding of a single document, with where it stands in its source."""

    policy_id: str
    rule_id: str
    resource_id: str
    state: str  # violation, error, refusal
    fingerprint: str
    message: str
    policy_set_id: str | None = None
    path: str | None = None
    actual: str | None = None
    expected: str | None = None
    anchor: tuple | None = None
    bundle_digest: str | None = None
    source: str | None = None

    @property
    def remediation(self) -> str:
        return self.message if self.message.strip() else f"fix resource to satisfy rule {self.rule_id}"

    def _place(self) -> list[tuple[str, object]]:
        at = [("path", self.source or self.resource_id)]
        if self.anchor and self.anchor[0] in ("textSpan", "cell"):
            at += [("line", self.anchor[1]), ("column", self.anchor[2])]
        return at

    def fields(self) -> list[tuple[str, object]]:
        anchor = None
        if self.anchor:
            kind, *where = self.anchor
            anchor = {"kind": kind} | dict(zip({"textSpan": ("startLine", "startColumn"), "cell": ("row", "column")}.get(kind, ("path",)), where))
        return [
            ("violationId", None if self.fingerprint == "-" else self.fingerprint), ("policyId", self.policy_id), ("policySetId", self.policy_set_id), ("ruleId", self.rule_id), ("bundleDigest", self.bundle_digest),
            ("subjectRef", self.resource_id), ("sourceAnchor", anchor), ("path", self.path), ("actual", self.actual), ("expected", self.expected), ("message", self.message), ("remediation", self.remediation),
            ("severity", "error"), ("state", self.state), ("resourceId", self.resource_id), ("fingerprint", self.fingerprint), ("location", dict(self._place())),
        ]

    def text(self) -> str:
        at = ":".join(str(v) for _, v in self._place())
        return f"[{self.state.upper()}] {self.rule_id} on {self.resource_id} at {at} — {self.remediation}"


def refusal(resource_id: str, reason: str) -> Finding:
    return Finding("-", "-", resource_id, "refusal", "-", reason)


def dedup(items: list[Finding]) -> list[Finding]:
    return list({(f.policy_id, f.rule_id, f.resource_id, f.fingerprint, f.state): f for f in reversed(items)}.values())[::-1]


def _json(v: object) -> str:
    return json.dumps(v) if not isinstance(v, str) else quote(v)


def render(items: list[Finding], form: str = "text") -> str:
    if form == "text":
        return "\n".join(f.text() for f in items) if items else "no findings"
    objects = ["{" + ",".join(f"{quote(k)}:{_json(v)}" for k, v in f.fields()) + "}" for f in items]
    if form == "jsonl":
        return "\n".join(objects)
    return json.dumps({"summary": {"total": len(items)}, "findings": [json.loads(o) for o in objects]}, indent=2, ensure_ascii=False)


def encode_event(verdict: str, count: int, digest: str | None, set_id: str | None, mode: str = "ENFORCED", would_deny: bool = False) -> str:
    return SEPARATOR.join(["v1", verdict, str(count), digest or "-", set_id or "-", mode, "true" if would_deny else "false"])


def decode_event(raw: str) -> dict[str, object]:
    parts = raw.split(SEPARATOR)
    if len(parts) not in (5, 7) or parts[0] != "v1" or not parts[2].lstrip("-").isdigit() or (len(parts) == 7 and parts[5] not in ("ENFORCED", "SHADOW")):
        raise ValueError("not a v1 check event")
    blank = lambda v: None if v == "-" else v
    return {"verdict": parts[1], "count": int(parts[2]), "digest": blank(parts[3]), "set_id": blank(parts[4]), "mode": parts[5] if len(parts) == 7 else "ENFORCED", "would_deny": len(parts) == 7 and parts[6] == "true"}


def event_column(verdict: Column, count: Column, digest: Column, set_id: Column, mode: Column, would_deny: Column) -> Column:
    """Events of many checks at once."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return F.concat_ws(SEPARATOR, F.lit("v1"), verdict, count.cast("string"), dash(digest), dash(set_id), mode, would_deny.cast("string"))


def exit_code(verdict: str, enforcement: str) -> int:
    return {"REFUSED": ADMISSION_ERROR, "ERRORED": EVALUATION_ERROR, "VIOLATED": VIOLATIONS if enforcement == "ENFORCED" else OK}.get(verdict, OK)
