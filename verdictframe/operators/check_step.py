"""A governed check of one encoded document: admission in a fixed order, one document, a decision, an event."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from datetime import datetime

from verdictframe.operators import governance
from verdictframe.operators.findings import encode_event
from verdictframe.plans import codec
from verdictframe.plans.ir import PolicySet, Refusal
from verdictframe.sources import decoders
from verdictframe.sources.readers import DEFAULT_BUDGET, check_budget


@dataclass(frozen=True)
class CheckOutput:
    verdict: str
    violating_rules: int
    report_digest: str | None
    rules: tuple[tuple[str, str], ...]  # rule key and outcome, sorted
    would_deny: bool
    denies: bool
    refusal: str | None = None
    event: str = ""


def _admit(encoded: str, budget: int, what: str) -> bytes:
    """Length of the text first, then its decoding, then the size."""
    if len(encoded) > -(-budget // 3) * 4:
        raise Refusal(f"{what}_TOO_LARGE", "encoded length is above the budget")
    try:
        raw = base64.b64decode(encoded, validate=True)
    except (binascii.Error, ValueError) as e:
        raise Refusal(f"{what}_NOT_BASE64", "payload is not base64") from e
    if len(raw) > budget:
        raise Refusal(f"{what}_TOO_LARGE", "decoded size is above the budget")
    return raw


def policy_check(
    resource: str, form: str, bundle: str, now: datetime, *, enforcement: str = governance.ENFORCED, layers: list[tuple[str, PolicySet]] | None = None, authorities: governance.Authorities | None = None,
    waivers: list[governance.Waiver] | None = None, budget: int = DEFAULT_BUDGET,
) -> CheckOutput:
    """Resource, bundle, format, decoder, verification: the first that fails decides. A waiver's subject is its own path here, and no scope is known."""
    try:
        check_budget(budget)
        raw, packed = _admit(resource, budget, "RESOURCE"), _admit(bundle, budget, "BUNDLE")
        if form not in ("JSON", "YAML", "CSV"):
            raise Refusal("UNKNOWN_FORMAT", f"unknown format {form}")
        document, _, _ = codec.unpack(packed)
        decoded = decoders.decode(raw, form)
        if len(decoded) != 1:
            raise Refusal("MULTI_DOCUMENT_RESOURCE", "a check takes a single document")
    except (Refusal, decoders.DecodeRefusal) as e:
        return CheckOutput("REFUSED", 0, None, (), False, True, e.code, encode_event("REFUSED", 0, None, None, enforcement))
    d = governance.decide(decoded[0].root, [*(layers or []), ("PIPELINE_LOCAL" if layers else "PROJECT", document.policies)], waivers or [], now, enforcement, authorities)
    if d.report is None:
        return CheckOutput("REFUSED", 0, None, (), False, True, "LAYERS_REFUSED", encode_event("REFUSED", 0, None, document.policies.id, enforcement))
    waived = {name for name, _, _ in d.waived}
    n = sum(e.outcome == "VIOLATED" and f"{p}/{r}" not in waived for (p, r), e in d.report.results.items())
    rules = tuple(sorted((f"{p}/{r}", e.outcome) for (p, r), e in d.report.results.items()))
    return CheckOutput(d.verdict, n, d.report.digest, rules, d.would_deny, d.denies, None, encode_event(d.verdict, n, d.report.digest, d.report.set_id, enforcement, d.would_deny))
