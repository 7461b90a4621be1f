"""Layers, waivers, verdicts and differences of reports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions.storage import free_names
from verdictframe.operators.evaluate import encode_parts, violation_fingerprint
from verdictframe.plans.ir import Authority, Policy, PolicySet, Refusal, Rule

#: Layers, strongest first; fixed names.
LAYERS = ("PLATFORM", "ORGANIZATION", "PROJECT", "PIPELINE_LOCAL")
#: Verdicts by precedence; fixed names.
VERDICTS = ("REFUSED", "ERRORED", "VIOLATED", "PASSED")
ENFORCED, SHADOW = "ENFORCED", "SHADOW"
#: Waivers up to which a rule's are a CASE in the plan; more of them are joined.
CASE_WAIVERS = 16
#: Rows of waivers up to which they are broadcast.
BROADCAST_WAIVERS = 100_000


class Authorities:
    """What the host grants, by issuer; the default grants nothing."""

    def __init__(self, *grants: Authority) -> None:
        self.grants = {g.issuer: g for g in grants}

    def covers(self, claim: Authority) -> bool:
        g = self.grants.get(claim.issuer)
        return g is not None and g.digest == claim.digest and g.layers >= claim.layers

    def authorizes(self, claim: Authority, layer: str) -> bool:
        return layer in claim.layers and self.covers(claim)


def compose(layers: list[tuple[str, PolicySet]], authorities: Authorities | None = None) -> PolicySet:
    """One policy set of several layers. A rule that is there already is replaced only by an explicit, granted supersession of itself."""
    authorities = authorities or Authorities()
    ordered = sorted(layers, key=lambda x: LAYERS.index(x[0]))
    placed: dict[tuple[str, str], str] = {}
    rules: dict[str, dict[str, Rule]] = {}
    for layer, members in ordered:
        for policy_id, rule in members.rules():
            key, s = (policy_id, rule.id), rule.supersession
            if key not in placed:
                if s is not None:
                    raise Refusal("UNKNOWN_SUPERSESSION_TARGET", f"supersession target (policyId={s.policy_id}, ruleId={s.rule_id}) not found below layer {layer}")
            elif s is None or (s.policy_id, s.rule_id) != key:
                raise Refusal("DUPLICATE_RULE_ID", f"rule {policy_id}/{rule.id} is in {placed[key]} and {layer} without explicit supersession")
            elif not authorities.authorizes(s.authority, layer):
                raise Refusal("AUTHORITY_LACKS_CAPABILITY", f"no host grant covers the claim of {s.authority.issuer} over {'+'.join(sorted(s.authority.layers))} for layer {layer}")
            placed[key] = layer
            rules.setdefault(policy_id, {})[rule.id] = rule
    if len(ordered) == 1:
        return ordered[0][1]
    return PolicySet("layered:" + "+".join(m.id for _, m in ordered), tuple(Policy(p, tuple(r.values())) for p, r in rules.items()))


@dataclass(frozen=True)
class Waiver:
    id: str
    policy_id: str
    rule_id: str
    subject_path: str
    subject_equals: str
    not_before: datetime
    not_after: datetime
    reason: str = ""
    issuer: str = ""
    dataset_scope: str | None = None
    project_scope: str | None = None
    fingerprint: str | None = None


@dataclass(frozen=True)
class WaiverContext:
    project: str | None = None
    dataset: str | None = None


WAIVER_SCHEMA = "waiver_no int, waiver_id string, w_policy string, w_rule string, subject_path string, subject_equals string, not_before timestamp, not_after timestamp, dataset_scope string, project_scope string, w_fingerprint string"


def waivers_frame(spark: SparkSession, waivers: list[Waiver]) -> DataFrame:
    rows = [(i, w.id, w.policy_id, w.rule_id, w.subject_path, w.subject_equals, w.not_before, w.not_after, w.dataset_scope, w.project_scope, w.fingerprint) for i, w in enumerate(waivers)]
    return spark.createDataFrame(rows, WAIVER_SCHEMA)


def apply_waivers(results: DataFrame, waivers: list[Waiver], now: datetime, subjects: dict[str, Column], context: WaiverContext | None = None) -> DataFrame:
    """`results` (with resource_fingerprint) plus fingerprint, waiver_id, waiver_state (WAIVED, ACTIVE, ACTIVE_EXPIRED, ACTIVE_NOT_YET_VALID; null where nothing is violated).

    The first waiver in the list that matches decides, valid or not. `subjects` gives a column of `results` for each subject path; a path
    without one matches nothing. Errors are never waived. Waivers that match are aggregated by the smallest number, so no group is sorted.
    """
    context = context or WaiverContext()
    if len(waivers) > CASE_WAIVERS:
        return join_waivers(results, waivers_frame(results.sparkSession, waivers), now, subjects, context)
    fp = violation_fingerprint(F.col("policy_set_id"), F.col("policy_id"), F.col("rule_id"), F.coalesce(F.col("location"), F.lit("")), F.col("resource_fingerprint"))
    broken = F.col("outcome").isin("VIOLATED", "ERROR")
    base = results.withColumn("fingerprint", F.when(broken, fp))
    chosen = F.lit(None).cast("struct<id:string,state:string>")
    usable = [w for w in waivers if w.subject_path in subjects and (w.project_scope is None or w.project_scope == context.project) and (w.dataset_scope is None or w.dataset_scope == context.dataset)]
    # a waiver names one rule, so a rule has few; the first match is a CASE over them
    for w in reversed(usable):
        hit = (F.col("policy_id") == w.policy_id) & (F.col("rule_id") == w.rule_id) & (subjects[w.subject_path] == w.subject_equals)
        if w.fingerprint is not None:
            hit = hit & (F.col("fingerprint") == w.fingerprint)
        state = "ACTIVE_EXPIRED" if now > w.not_after else "ACTIVE_NOT_YET_VALID" if now < w.not_before else "WAIVED"
        chosen = F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(w.id).alias("id"), F.lit(state).alias("state"))).otherwise(chosen)
    out = base.withColumn("_w", F.when(F.col("outcome") == "VIOLATED", chosen))
    return out.withColumn("waiver_id", F.col("_w.id")).withColumn("waiver_state", F.when(broken, F.coalesce(F.col("_w.state"), F.lit("ACTIVE")))).drop("_w")


def join_waivers(results: DataFrame, waivers: DataFrame, now: datetime, subjects: dict[str, Column], context: WaiverContext | None = None) -> DataFrame:
    """apply_waivers for a table of waivers (WAIVER_SCHEMA), of any size: for each subject path a join on policy, rule and subject.

    The table is broadcast only if it is known to be small. Of all that match, over all paths, the one with the smallest number decides.
    """
    context = context or WaiverContext()
    fp = violation_fingerprint(F.col("policy_set_id"), F.col("policy_id"), F.col("rule_id"), F.coalesce(F.col("location"), F.lit("")), F.col("resource_fingerprint"))
    broken = F.col("outcome").isin("VIOLATED", "ERROR")
    names = free_names([*results.columns, "fingerprint", "waiver_id", "waiver_state"], "w_policy", "w_rule", "w_subject", "w_print", "w_best", "w_hit")
    policy, rule, subject, mark, best, hit = names
    base = results.withColumn("fingerprint", F.when(broken, fp)).withColumn(best, F.lit(None).cast("struct<waiver_no:int,waiver_id:string,state:string>"))
    scoped = lambda c, v: F.col(c).isNull() | (F.col(c) == F.lit(v)) if v is not None else F.col(c).isNull()
    state = F.when(F.lit(now) > F.col("not_after"), "ACTIVE_EXPIRED").when(F.lit(now) < F.col("not_before"), "ACTIVE_NOT_YET_VALID").otherwise("WAIVED")
    small = waivers.count() <= BROADCAST_WAIVERS
    for path, value in subjects.items():
        side = waivers.where((F.col("subject_path") == path) & scoped("project_scope", context.project) & scoped("dataset_scope", context.dataset))
        # the first of several waivers for a rule, subject and fingerprint
        first = side.groupBy(F.col("w_policy").alias(policy), F.col("w_rule").alias(rule), F.col("subject_equals").alias(subject), F.col("w_fingerprint").alias(mark))
        first = first.agg(F.min(F.struct("waiver_no", "waiver_id", state.alias("state"))).alias(hit))
        for exact in (True, False):
            part = first.where(F.col(mark).isNotNull() if exact else F.col(mark).isNull())
            on = (F.col("policy_id") == F.col(policy)) & (F.col("rule_id") == F.col(rule)) & (value == F.col(subject))
            on = on & (F.col("fingerprint") == F.col(mark)) if exact else on
            joined = base.join(F.broadcast(part) if small else part, on, "left")
            base = joined.withColumn(best, F.least(F.col(best), F.col(hit))).drop(policy, rule, subject, mark, hit)
    found = F.when(F.col("outcome") == "VIOLATED", F.col(best))
    return base.withColumn("waiver_id", found["waiver_id"]).withColumn("waiver_state", F.when(broken, F.coalesce(found["state"], F.lit("ACTIVE")))).drop(best)


def waiver_counts(results: DataFrame, *by: str) -> DataFrame:
    """waived, active, expired, not_yet_valid, errors: results with a waiver_state by what became of them; for each value of `by`, or in all."""
    violated = F.col("outcome") == "VIOLATED"
    of = lambda *states: F.count_if(violated & F.col("waiver_state").isin(*states))
    return results.groupBy(*by).agg(
        of("WAIVED").alias("waived"), of("ACTIVE", "ACTIVE_EXPIRED", "ACTIVE_NOT_YET_VALID").alias("active"), of("ACTIVE_EXPIRED").alias("expired"),
        of("ACTIVE_NOT_YET_VALID").alias("not_yet_valid"), F.count_if(F.col("outcome") == "ERROR").alias("errors"),
    )


def tally(results: DataFrame, *by: str) -> DataFrame:
    """errors, violating_rules (each counts once); for each value of `by`, or in all. `results` may have waiver_state."""
    active = (F.col("outcome") == "VIOLATED") & (F.coalesce(F.col("waiver_state"), F.lit("ACTIVE")) != "WAIVED") if "waiver_state" in results.columns else F.col("outcome") == "VIOLATED"
    key = F.struct("policy_id", "rule_id")
    # rules are few, so one row for each rule first: no distinct over all rows
    per_rule = results.groupBy(*by, "policy_id", "rule_id").agg(F.count_if(F.col("outcome") == "ERROR").alias("errors"), F.count_if(active).alias("active"))
    return per_rule.groupBy(*by).agg(F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"), F.count(F.when(F.col("active") > 0, key)).alias("violating_rules"))


def verdict_column(refusals: Column, errors: Column, violations: Column) -> Column:
    return F.when(refusals > 0, "REFUSED").when(errors > 0, "ERRORED").when(violations > 0, "VIOLATED").otherwise("PASSED")


def verdicts(results: DataFrame, enforcement: str, *by: str, refusals: Column | int = 0) -> DataFrame:
    """errors, violating_rules, verdict, denies, would_deny. SHADOW holds back only what is VIOLATED."""
    refused = refusals if isinstance(refusals, Column) else F.lit(refusals)
    t = tally(results, *by).withColumn("verdict", verdict_column(refused, F.col("errors"), F.col("violating_rules")))
    denies = F.col("verdict").isin("REFUSED", "ERRORED") | ((F.col("verdict") == "VIOLATED") & F.lit(enforcement == ENFORCED))
    return t.withColumn("denies", denies).withColumn("would_deny", (F.col("verdict") == "VIOLATED") & F.lit(enforcement == SHADOW))


def diff_reports(a: DataFrame, b: DataFrame, waived: bool = False) -> DataFrame:
    """resource_id, policy_id, rule_id, category, policy_set_id, fingerprint, privilege_expansion of what differs between two reports.

    Both have resource_fingerprint; a rule that one lacks counts as not applicable there. With `waived`, both have waiver_state, a waived
    violation counts as passed where the raw outcomes differ, and where they agree a waiver on one side only is WAIVER_EFFECT_CHANGED.
    A resource whose fingerprints differ is not compared: it has the one row CORPUS_MISMATCH, without policy, rule and fingerprint.
    """
    keys = ["resource_id", "policy_id", "rule_id"]

    def side(df: DataFrame, n: str) -> DataFrame:
        is_waived = F.coalesce(F.col("waiver_state") == "WAIVED", F.lit(False)) if waived else F.lit(False)
        return df.select(*keys, F.col("policy_set_id").alias(f"set_{n}"), F.col("outcome").alias(f"raw_{n}"), F.col("severity").alias(f"sev_{n}"), F.coalesce("location", F.lit("root")).alias(f"loc_{n}"), F.col("resource_fingerprint").alias(f"fp_{n}"), is_waived.alias(f"w_{n}"))

    differ = mismatched_corpora(a, b)
    j = side(a, "a").join(side(b, "b"), keys, "full_outer").join(differ, "resource_id", "left_anti")
    raw = {n: F.coalesce(F.col(f"raw_{n}"), F.lit("NOT_APPLICABLE")) for n in "ab"}
    w = {n: F.coalesce(F.col(f"w_{n}"), F.lit(False)) for n in "ab"}
    same = raw["a"] == raw["b"]
    state = {n: F.when(~same & w[n] & (raw[n] == "VIOLATED"), "PASSED").otherwise(raw[n]) for n in "ab"}
    severity = F.coalesce(F.col("sev_a") != F.col("sev_b"), F.lit(False))
    sa, sb = state["a"], state["b"]
    category = (
        F.when((sa == sb) & ~severity, None).when((sa == "ERROR") & (sb != "ERROR"), "ERROR_RESOLVED").when((sa != "ERROR") & (sb == "ERROR"), "ERROR_INTRODUCED")
        .when((sa == "VIOLATED") & (sb != "VIOLATED"), "RESOLVED_VIOLATION").when((sa != "VIOLATED") & (sb == "VIOLATED"), "NEW_VIOLATION")
        .when((sa == "NOT_APPLICABLE") != (sb == "NOT_APPLICABLE"), "APPLICABILITY_CHANGED").when(severity, "SEVERITY_CHANGED")
    )
    effect = F.when(same & (w["a"] != w["b"]), "WAIVER_EFFECT_CHANGED")
    has_a = F.col("raw_a").isNotNull()
    pick = lambda n: F.when(has_a, F.col(f"{n}_a")).otherwise(F.col(f"{n}_b"))
    fp = violation_fingerprint(pick("set"), F.col("policy_id"), F.col("rule_id"), pick("loc"), pick("fp"))
    each = j.select(*keys, F.explode(F.array_compact(F.array(category, effect))).alias("category"), pick("set").alias("policy_set_id"), fp.alias("fingerprint"))
    none = F.lit(None).cast("string")
    refused = differ.select("resource_id", none.alias("policy_id"), none.alias("rule_id"), F.lit("CORPUS_MISMATCH").alias("category"), none.alias("policy_set_id"), none.alias("fingerprint"))
    return each.unionByName(refused).withColumn("privilege_expansion", F.col("category") == "RESOLVED_VIOLATION")


def mismatched_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """resource_ids whose fingerprints differ between two reports: these can't be compared."""
    both = a.select("resource_id", "resource_fingerprint").unionByName(b.select("resource_id", "resource_fingerprint"))
    seen = both.groupBy("resource_id").agg(F.min("resource_fingerprint").alias("least"), F.max("resource_fingerprint").alias("most"))
    return seen.where("least <> most").select("resource_id")


def diff_digest(diff: DataFrame, *by: str) -> DataFrame:
    """diff_digest over the sorted entries; for each value of `by`, whose entries are gathered (as many as rules), or in all."""
    key = encode_parts(F.col("policy_set_id"), F.col("policy_id"), F.col("rule_id"))
    each = diff.select(*by, F.struct("category", "fingerprint", key.alias("k"), F.col("privilege_expansion").cast("string").alias("x")).alias("e"))
    grouped = each.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("es"))
    text = F.concat(F.size("es").cast("string"), F.lit(":"), F.array_join(F.transform("es", lambda e: encode_parts(e["category"], e["fingerprint"], e["k"], e["x"])), ""))
    return grouped.select(*by, F.sha2(text, 256).alias("diff_digest"))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an ordinal column, by aggregation rather than a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


@dataclass
class Decision:
    """What `decide` returns for one document."""

    verdict: str
    denies: bool
    would_deny: bool
    report: object = None
    waived: list[tuple[str, str, str]] = field(default_factory=list)


def waive_report(report, waivers: list[Waiver], now: datetime, subject, context: WaiverContext | None = None) -> list[tuple[tuple[str, str], str, str | None, str]]:
    """(rule, fingerprint, waiver id, state) of each violation and error of a document's report."""
    from verdictframe.functions.interpreter import violation_fingerprint as fingerprint

    context, out = context or WaiverContext(), []
    for (policy_id, rule_id), e in report.results.items():
        for v in e.violations:
            fp = fingerprint(report.set_id, policy_id, rule_id, v.location, report.fingerprint)
            found = None
            if e.outcome == "VIOLATED":
                for w in waivers:
                    scoped = (w.project_scope is None or w.project_scope == context.project) and (w.dataset_scope is None or w.dataset_scope == context.dataset)
                    if (w.policy_id, w.rule_id) == (policy_id, rule_id) and subject(w.subject_path) == w.subject_equals and scoped and w.fingerprint in (None, fp):
                        found = w
                        break
            state = "ACTIVE" if found is None else "ACTIVE_EXPIRED" if now > found.not_after else "ACTIVE_NOT_YET_VALID" if now < found.not_before else "WAIVED"
            out.append(((policy_id, rule_id), fp, found.id if found else None, state))
    return out


def decide(tree: object, layers: list[tuple[str, PolicySet]], waivers: list[Waiver], now: datetime, enforcement: str = ENFORCED, authorities: Authorities | None = None, subject=lambda path: path, context: WaiverContext | None = None) -> Decision:
    """Compose, evaluate, waive, decide: one document. A refused composition is a REFUSED verdict."""
    from verdictframe.functions.interpreter import evaluate

    try:
        policies = compose(layers, authorities)
    except Refusal:
        return Decision("REFUSED", True, False)
    report = evaluate(policies, tree)
    outcomes = waive_report(report, waivers, now, subject, context)
    errors = sum(e.outcome == "ERROR" for e in report.results.values())
    active = {k for k, _, _, state in outcomes if state != "WAIVED" and report.results[k].outcome == "VIOLATED"}
    verdict = "ERRORED" if errors else "VIOLATED" if active else "PASSED"
    return Decision(verdict, verdict == "ERRORED" or (verdict == "VIOLATED" and enforcement == ENFORCED), verdict == "VIOLATED" and enforcement == SHADOW, report, [(f"{k[0]}/{k[1]}", fp, w or "") for k, fp, w, s in outcomes if s == "WAIVED"])


def superseding(rule: Rule, policy_id: str, authority: Authority, reason: str = "") -> Rule:
    from verdictframe.plans.ir import Supersession

    return replace(rule, supersession=Supersession(policy_id, rule.id, reason, authority))
