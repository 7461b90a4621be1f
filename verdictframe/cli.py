"""Command line: compile, inspect, shape, bundle, check, test, diff, explain, stream.

    python -m verdictframe.cli check --policy rules.bundle service.json
"""

from __future__ import annotations

import hashlib
import json
import sys
from datetime import datetime, timezone
from pathlib import Path

from verdictframe.functions import interpreter
from verdictframe.operators import dataset, findings, governance
from verdictframe.operators.findings import ADMISSION_ERROR, COMPILER_ERROR, EVALUATION_ERROR, OK, USAGE, VIOLATIONS, Finding
from verdictframe.plans import codec
from verdictframe.plans.ir import CODES, Authority, CollectionPredicate, Comparison, Expression, FieldRef, Literal, Not, PolicySet, Refusal, dotted, tag
from verdictframe.sources import decoders
from verdictframe.sources.readers import DEFAULT_BUDGET

COMMANDS = {
    "check": "evaluate resources against a bundle", "test": "run allow and deny fixtures", "diff": "compare two bundles on a resource", "explain": "show a rule", "compile": "rules as JSON to a bundle",
    "inspect": "a bundle's rules as JSON", "shape": "counts of a bundle", "bundle": "verify a bundle", "stream": "evaluate row files in one pass",
}
REPEATED = ("layer", "grant")


class _Exit(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def parse(argv: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Positional arguments and flags; a flag given again keeps all its values, and single reads take the last."""
    words, flags, i = [], {}, 0
    while i < len(argv):
        if argv[i].startswith("--"):
            name, sign, value = argv[i][2:].partition("=")
            if not sign and name not in ("verify", "help", "json") and i + 1 < len(argv):
                i += 1
                value = argv[i]
            flags.setdefault(name, []).append(value)
        else:
            words.append(argv[i])
        i += 1
    return words, flags


def _flag(flags: dict[str, list[str]], name: str, default: str | None = None) -> str:
    if name in flags and flags[name][-1]:
        return flags[name][-1]
    if default is None:
        raise _Exit(USAGE, f"--{name} is needed")
    return default


def _read(path: str, budget: int = DEFAULT_BUDGET) -> bytes:
    try:
        if Path(path).stat().st_size > budget:
            raise _Exit(ADMISSION_ERROR, f"{path} is larger than {budget} bytes")
        return Path(path).read_bytes()
    except OSError as e:
        raise _Exit(ADMISSION_ERROR, f"{path} can't be read: {e.strerror}") from e


def _bundle(path: str) -> codec.Document:
    try:
        return codec.unpack(_read(path))[0]
    except Refusal as e:
        raise _Exit(ADMISSION_ERROR, f"bundle refused: {e}") from e


def _documents(path: str) -> list[decoders.Decoded]:
    try:
        return decoders.decode(_read(path), decoders.format_of(path))
    except decoders.DecodeRefusal as e:
        raise _Exit(ADMISSION_ERROR, str(e)) from e


def _layers(flags: dict[str, list[str]], base: PolicySet) -> tuple[list[tuple[str, PolicySet]], governance.Authorities]:
    layers, grants = [("PIPELINE_LOCAL" if flags.get("layer") else "PROJECT", base)], []
    for text in flags.get("layer", []):
        name, sign, path = text.partition("=")
        if not sign or name not in governance.LAYERS:
            raise _Exit(USAGE, f"--layer needs LAYER=bundle, not {text}")
        layers.append((name, _bundle(path).policies))
    for text in flags.get("grant", []):
        parts = text.split(":")
        if len(parts) != 3 or not set(parts[1].split("+")) <= set(governance.LAYERS):
            raise _Exit(USAGE, f"--grant needs issuer:LAYER:digest, not {text}")
        grants.append(Authority(parts[0], frozenset(parts[1].split("+")), parts[2]))
    return layers, governance.Authorities(*grants)


def _enforcement(flags: dict[str, list[str]]) -> str:
    mode = _flag(flags, "enforcement", "ENFORCED").upper()
    if mode not in (governance.ENFORCED, governance.SHADOW):
        raise _Exit(USAGE, f"unknown enforcement {mode}")
    return mode


def document_findings(report: interpreter.Report, decoded: decoders.Decoded, source: str, digest: str) -> list[Finding]:
    out = []
    for (policy_id, rule_id), e in report.results.items():
        for v in e.violations:
            fp = interpreter.violation_fingerprint(report.set_id, policy_id, rule_id, v.location, report.fingerprint)
            anchor = decoders.anchor_of(decoded, tuple(v.location.split(".")) if v.location else ())
            out.append(Finding(policy_id, rule_id, decoded.id, "violation" if e.outcome == "VIOLATED" else "error", fp, v.message, report.set_id, v.location, v.actual, v.expected, anchor, digest, source))
    return out


def check(words: list[str], flags: dict[str, list[str]], out) -> int:
    if not words:
        raise _Exit(USAGE, "no resources given")
    base, mode, now = _bundle(_flag(flags, "policy")), _enforcement(flags), datetime.now(timezone.utc)
    layers, authorities = _layers(flags, base.policies)
    digest, found, tally = codec.semantic_digest(base), [], {"REFUSED": 0, "ERRORED": 0, "VIOLATED": 0}
    for path in words:
        try:
            decoded = _documents(path)
        except _Exit as e:
            found.append(findings.refusal(path, str(e)))
            tally["REFUSED"] += 1
            continue
        for d in decoded:
            decision = governance.decide(d.root, layers, [], now, mode, authorities)
            if decision.report is None:
                found.append(findings.refusal(path, "policy layers refused"))
            else:
                found += document_findings(decision.report, d, path, digest)
            if decision.verdict in tally:
                tally[decision.verdict] += 1
    verdict = next((v for v in ("REFUSED", "ERRORED", "VIOLATED") if tally[v]), "PASSED")
    out(findings.render(findings.dedup(found), _flag(flags, "format", "text")))
    return findings.exit_code(verdict, mode)


def test(words: list[str], flags: dict[str, list[str]], out) -> int:
    base, folder = _bundle(_flag(flags, "policy")), Path(_flag(flags, "fixtures"))
    fixtures = sorted(p for p in folder.iterdir() if ".allow." in p.name or ".deny." in p.name) if folder.is_dir() else []
    if not fixtures:
        raise _Exit(USAGE, "no *.allow.* or *.deny.* fixtures found")
    code = OK
    for p in fixtures:
        expectation = "allow" if ".allow." in p.name else "deny"
        line: dict[str, object] = {"fixture": p.name}
        try:
            reports = [interpreter.evaluate(base.policies, d.root) for d in _documents(str(p))]
        except _Exit as e:
            line |= {"status": "refused", "message": str(e)}
            code = max(code, ADMISSION_ERROR)
        else:
            errors = [e.violations[0].message for r in reports for e in r.results.values() if e.outcome == "ERROR"]
            n = sum(any(e.outcome == "VIOLATED" for e in r.results.values()) for r in reports)
            ok = (n == 0) == (expectation == "allow")
            line |= {"status": "error", "message": errors[0]} if errors else {"expectation": expectation, "violations": n, "status": "pass" if ok else "FAIL"}
            code = max(code, EVALUATION_ERROR if errors else OK if ok else VIOLATIONS)
        out(json.dumps(line, ensure_ascii=False))
    return code


def document_diff(a: interpreter.Report, b: interpreter.Report) -> list[dict[str, object]]:
    """Differences of two reports on one document, sorted by category, fingerprint and rule."""
    if a.fingerprint != b.fingerprint:
        raise Refusal("CORPUS_MISMATCH", "the reports are on different documents")
    out = []
    for key in {**a.results, **b.results}:
        sa, sb = (r.results[key].outcome if key in r.results else "NOT_APPLICABLE" for r in (a, b))
        va, vb = a.severities.get(key), b.severities.get(key)
        changed = va is not None and vb is not None and va != vb
        if sa == sb and not changed:
            continue
        category = (
            "ERROR_RESOLVED" if sa == "ERROR" != sb else "ERROR_INTRODUCED" if sb == "ERROR" != sa else "RESOLVED_VIOLATION" if sa == "VIOLATED" != sb else "NEW_VIOLATION" if sb == "VIOLATED" != sa
            else "APPLICABILITY_CHANGED" if "NOT_APPLICABLE" in (sa, sb) and sa != sb else "SEVERITY_CHANGED"
        )
        side = a if key in a.results else b
        first = next(iter(side.results[key].violations), None)
        fp = interpreter.violation_fingerprint(side.set_id, *key, first.location if first else "root", side.fingerprint)
        out.append({"category": category, "policyId": key[0], "ruleId": key[1], "fingerprint": fp, "privilegeExpansion": category == "RESOLVED_VIOLATION"})
    return sorted(out, key=lambda d: (d["category"], d["fingerprint"], d["ruleId"]))


def diff(words: list[str], flags: dict[str, list[str]], out) -> int:
    a, b = _bundle(_flag(flags, "a")), _bundle(_flag(flags, "b"))
    paths = words or flags.get("corpus", [])
    if len(paths) != 1:
        raise _Exit(EVALUATION_ERROR, "diff takes one resource")
    decoded = _documents(paths[0])
    if len(decoded) != 1:
        raise _Exit(ADMISSION_ERROR, "diff takes a single document")
    entries = document_diff(interpreter.evaluate(a.policies, decoded[0].root), interpreter.evaluate(b.policies, decoded[0].root))
    out(json.dumps({"entries": entries}, indent=2))
    return VIOLATIONS if entries else OK


def describe(e: Expression, depth: int = 0) -> list[str]:
    pad = "  " * depth
    if isinstance(e, Literal):
        return [f"{pad}literal {tag(e.value)} {e.value}"]
    if isinstance(e, FieldRef):
        return [f"{pad}field {dotted(e.path)} {e.expected}{' optional' if e.optional else ''}"]
    if isinstance(e, Comparison):
        return [f"{pad}{e.op}", *describe(e.left, depth + 1), *describe(e.right, depth + 1)]
    if isinstance(e, Not):
        return [f"{pad}NOT", *describe(e.body, depth + 1)]
    if isinstance(e, CollectionPredicate):
        return [f"{pad}{e.op} of elements with {dotted(e.predicate.path)} {e.predicate.expected or 'of any type'}", *describe(e.source, depth + 1)]
    return [f"{pad}{type(e).__name__} {e.name}"]


def explain(words: list[str], flags: dict[str, list[str]], out) -> int:
    base, wanted = _bundle(_flag(flags, "policy")), _flag(flags, "rule")
    hits = [(p, r) for p, r in base.policies.rules() if wanted in (r.id, f"{p}/{r.id}")]
    if len(hits) != 1:
        raise _Exit(USAGE, f"{'no rule' if not hits else 'several rules'} named {wanted}")
    policy_id, rule = hits[0]
    out(f"rule {policy_id}/{rule.id}: {rule.message}")
    if rule.applies_when is not None:
        out("applies when\n" + "\n".join(describe(rule.applies_when, 1)))
    out("requires\n" + "\n".join(describe(rule.expression, 1)))
    if "resource" in flags:
        e = interpreter.evaluate_rule(rule, _documents(_flag(flags, "resource"))[0].root)
        out(f"outcome {e.outcome}" + "".join(f"\n  {v.code} at {v.location or 'root'}: expected {v.expected}, got {v.actual}" for v in e.violations))
    return OK


def compile_(words: list[str], flags: dict[str, list[str]], out) -> int:
    source, target = _flag(flags, "policy", flags["ir"][-1] if flags.get("ir") else words[0] if words else None), _flag(flags, "out")
    try:
        d = codec.decode(_read(source))
        lowered = codec.lower(d.policies, d.functions, d.shapes)
        raw = codec.pack(codec.replace(lowered, parameters=d.parameters, source_refs=d.source_refs, language=d.language))
    except Refusal as e:
        raise _Exit(COMPILER_ERROR, str(e)) from e
    Path(target).write_bytes(raw)
    out(json.dumps({"out": target, "bundleSha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)}))
    return OK


def inspect(words: list[str], flags: dict[str, list[str]], out) -> int:
    out(codec.encode(_bundle(_flag(flags, "policy", words[0] if words else None))).decode())
    return OK


def shape(words: list[str], flags: dict[str, list[str]], out) -> int:
    out(json.dumps(codec.shape_summary(_bundle(_flag(flags, "policy", words[0] if words else None)))))
    return OK


def bundle(words: list[str], flags: dict[str, list[str]], out) -> int:
    """Verify every bundle given; one that is refused doesn't end the run."""
    targets = [*[f for f in flags.get("verify", []) if f], *words]
    if not targets:
        raise _Exit(USAGE, "no bundles given")
    code = OK
    for path in targets:
        try:
            d = _bundle(path)
        except _Exit as e:
            out(json.dumps({"path": path, "verified": False, "reason": str(e)}))
            code = ADMISSION_ERROR
        else:
            out(json.dumps({"path": path, "verified": True, "semanticDigest": codec.semantic_digest(d), "policySetId": d.policies.id}))
    return code


def stream(words: list[str], flags: dict[str, list[str]], out) -> int:
    """Each file is evaluated on its own, with row numbers and a budget of its own, up to the first file that is refused or in error; then
    nothing but that is reported. Violations add up, and the last row is that of the last file with one."""
    as_json = _flag(flags, "format-out", "text") == "json"

    def say(status: str, message: str) -> None:
        out(json.dumps({"status": status, "message": message}) if as_json else f"stream: {message}")

    base = _bundle(_flag(flags, "policy"))
    budget = _flag(flags, "row-budget", str(dataset.DEFAULT_ROW_BUDGET))
    if not budget.isdigit() or int(budget) <= 0:
        raise _Exit(USAGE, "--row-budget must be a positive number")
    if not words:
        raise _Exit(USAGE, "no data sets given")
    try:
        the_plan = dataset.plan(base.policies, int(budget), specs=[dataset.DatasetSpec(Path(w).stem, Path(w).suffix[1:]) for w in words])
    except Refusal as e:
        say("plan-refusal", f"plan refused: {e}")
        return EVALUATION_ERROR
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from verdictframe.functions.storage import materialize
    from verdictframe.sources.readers import read_rows

    spark = SparkSession.builder.getOrCreate()
    violations, last_row, lines = 0, -1, []
    for path in words:
        if not Path(path).is_file():
            say("refusal", f"data set not found: {path}")
            return ADMISSION_ERROR
        rows = materialize(read_rows(spark, f"file://{Path(path).resolve()}"), "rows")
        refused = rows.where("refusal is not null").first()
        read = rows.where("refusal is null") if refused else rows
        outcomes = dataset.evaluate_dataset(read.select("row_no", F.parse_json("row").alias("doc")), the_plan, "row_no", document="doc")[0].collect()  # a row for each rule
        stopped = next((r.message for r in outcomes if r.message and r.message.startswith("row_budget")), None)
        if stopped:
            say("budget-exceeded", stopped)
            return EVALUATION_ERROR
        if refused:
            say("decode-refusal", f"{path}: {refused.refusal} at {refused.anchor}")
            return ADMISSION_ERROR
        for r in outcomes:
            if r.outcome == "ERROR":
                say("refusal", f"rule {r.policy_id}/{r.rule_id}: {r.message}")
                return EVALUATION_ERROR
            violations += r.violations
            last_row = r.last_row if r.outcome == "VIOLATED" and r.last_row is not None else last_row
            if r.outcome == "AGGREGATE":
                lines.append(f"aggregate {r.policy_id}/{r.rule_id} = {r.value}")
    if as_json:
        out(json.dumps({"status": "violations" if violations else "ok", "violations": violations, "lastViolationRow": last_row}))
    else:
        for line in [*lines, f"stream: violations={violations} (last row {last_row})" if violations else "stream: ok"]:
            out(line)
    return VIOLATIONS if violations else OK


def main(argv: list[str], out=print) -> int:
    name, *rest = argv or ["help"]
    run = {"check": check, "test": test, "diff": diff, "explain": explain, "compile": compile_, "inspect": inspect, "shape": shape, "bundle": bundle, "stream": stream}.get(name)
    words, flags = parse(rest)
    if run is None or "help" in flags:
        out(json.dumps({"commands": [{"name": n, "summary": s} for n, s in COMMANDS.items()], "violationCodes": list(CODES)}, indent=2))
        return OK if run or name in ("help", "--help") else USAGE
    try:
        return run(words, flags, out)
    except _Exit as e:
        out(f"{name}: {e}")
        return e.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
