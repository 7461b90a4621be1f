"""Layers, waivers, verdicts, differences; tables and single documents agree."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from verdictframe.functions import interpreter
from verdictframe.operators import evaluate, governance
from verdictframe.operators.governance import Authorities, Waiver, WaiverContext, compose, decide
from verdictframe.plans import dsl
from verdictframe.plans.ir import Authority, Refusal, number

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
DAY = timedelta(days=1)
LIMIT = lambda n: dsl.rule("limit", require=dsl.root("spec").field("replicas").number().lte(n))


def layer(name, *rules):
    return dsl.policy_set(name, dsl.policy("p", *rules))


def test_layers():
    only = layer("a", LIMIT(5))
    assert compose([("PROJECT", only)]) is only
    both = compose([("PROJECT", layer("b", dsl.rule("other", require=dsl.root("x").number().eq(1)))), ("PLATFORM", only)])
    assert both.id == "layered:a+b" and [r.id for _, r in both.rules()] == ["limit", "other"]
    with pytest.raises(Refusal, match="without explicit"):
        compose([("PLATFORM", only), ("PROJECT", layer("b", LIMIT(9)))])


def test_supersession_needs_a_target_and_a_grant():
    claim = Authority("sec", frozenset({"PROJECT"}), "d")
    over = layer("b", governance.superseding(LIMIT(10), "p", claim))
    layers = [("PROJECT", over), ("ORGANIZATION", layer("a", LIMIT(5)))]
    with pytest.raises(Refusal) as e:
        compose(layers)
    assert e.value.code == "AUTHORITY_LACKS_CAPABILITY"
    for grant in (Authority("sec", frozenset({"PROJECT"}), "other"), Authority("sec", frozenset({"PLATFORM"}), "d"), Authority("x", frozenset({"PROJECT"}), "d")):
        with pytest.raises(Refusal):
            compose(layers, Authorities(grant))
    granted = Authorities(Authority("sec", frozenset({"PROJECT", "PLATFORM"}), "d"))
    assert compose(layers, granted).rules()[0][1].expression.right.value == number(10)
    with pytest.raises(Refusal) as e:
        compose([("PROJECT", over)], granted)
    assert e.value.code == "UNKNOWN_SUPERSESSION_TARGET"
    assert decide({"spec": {"replicas": number(8)}}, layers, [], NOW, authorities=granted).verdict == "PASSED"
    assert decide({"spec": {"replicas": number(8)}}, layers, [], NOW).verdict == "REFUSED"


def waiver(name, before=-DAY, after=DAY, **more):
    return Waiver(name, "p", "limit", "team", "x", NOW + before, NOW + after, **more)


CASES = {
    "waived": ([waiver("w")], "WAIVED"), "bounds are in": ([waiver("w", timedelta(0), timedelta(0))], "WAIVED"), "expired": ([waiver("w", -2 * DAY, -DAY)], "ACTIVE_EXPIRED"),
    "early": ([waiver("w", DAY, 2 * DAY)], "ACTIVE_NOT_YET_VALID"), "the first decides": ([waiver("old", -2 * DAY, -DAY), waiver("new")], "ACTIVE_EXPIRED"), "unknown scope": ([waiver("w", dataset_scope="d")], "ACTIVE"),
    "right scope": ([waiver("w", project_scope="mine")], "WAIVED"), "wrong scope first": ([waiver("w", project_scope="other"), waiver("v")], "WAIVED"), "wrong fingerprint": ([waiver("w", fingerprint="0")], "ACTIVE"),
}


@pytest.mark.parametrize("case", CASES)
def test_waivers(spark, case):
    waivers, want = CASES[case]
    context = WaiverContext(project="mine")
    tree = {"spec": {"replicas": number(9)}}
    report = interpreter.evaluate(layer("s", LIMIT(5)), tree)
    assert governance.waive_report(report, waivers, NOW, lambda path: "x" if path == "team" else None, context)[0][3] == want
    df = spark.createDataFrame([(1, 9, "x"), (2, 9, "y"), (3, 1, "x"), (4, None, "x")], "id long, replicas int, team string")
    results = evaluate.evaluate(df.selectExpr("id", "struct(replicas) as spec"), layer("s", LIMIT(5)), "id").join(df.selectExpr("cast(id as string) as resource_id", "team"), "resource_id").withColumn("resource_fingerprint", F.lit("f"))
    for out in (governance.apply_waivers(results, waivers, NOW, {"team": F.col("team")}, context), governance.join_waivers(results, governance.waivers_frame(spark, waivers), NOW, {"team": F.col("team")}, context)):
        assert {r.resource_id: r.waiver_state for r in out.collect()} == {"1": want, "2": "ACTIVE", "3": None, "4": "ACTIVE"}


def test_hundreds_of_waivers_over_several_subjects(spark):
    df = spark.createDataFrame([(i, 9, f"t{i}") for i in range(30)], "id long, replicas int, team string")
    results = evaluate.evaluate(df.selectExpr("id", "team", "struct(replicas) as spec"), layer("s", LIMIT(5)), "id", keep={"team": "team"}).withColumn("resource_fingerprint", F.lit("f"))
    many = [Waiver(f"old{i}", "p", "limit", "team", f"t{i}", NOW - 2 * DAY, NOW - DAY) for i in range(0, 900, 2)] + [Waiver(f"id{i}", "p", "limit", "id", str(i), NOW - DAY, NOW + DAY) for i in range(20)]
    subjects = {"team": F.col("team"), "id": F.col("resource_id")}
    got = {int(r.resource_id): (r.waiver_id, r.waiver_state) for r in governance.apply_waivers(results, many, NOW, subjects).collect()}
    assert got == {i: (f"old{i}", "ACTIVE_EXPIRED") if i % 2 == 0 else (f"id{i}", "WAIVED") if i < 20 else (None, "ACTIVE") for i in range(30)}
    few = governance.apply_waivers(results, many[:8] + many[450:458], NOW, subjects)
    assert {r.resource_id: r.waiver_id for r in few.collect()} == {r.resource_id: r.waiver_id for r in governance.join_waivers(results, governance.waivers_frame(spark, many[:8] + many[450:458]), NOW, subjects).collect()}
    assert governance.waiver_counts(governance.apply_waivers(results, many, NOW, subjects)).first().asDict() == {"waived": 10, "active": 20, "expired": 15, "not_yet_valid": 0, "errors": 0}


def test_verdicts():
    tree = lambda x: {"spec": {"replicas": x}}
    layers = [("PROJECT", layer("s", LIMIT(5)))]
    for value, mode, verdict, denies, would in ((number(1), "ENFORCED", "PASSED", False, False), (number(9), "ENFORCED", "VIOLATED", True, False), (number(9), "SHADOW", "VIOLATED", False, True), ("x", "SHADOW", "ERRORED", True, False)):
        d = decide(tree(value), layers, [], NOW, mode)
        assert (d.verdict, d.denies, d.would_deny) == (verdict, denies, would)


def test_corpus_of_twenty(spark):
    df = spark.createDataFrame([(i, f"svc-{i}", f"team-{i}") for i in range(20)], "id long, name string, team string")
    out = evaluate.evaluate(df, layer("s", dsl.rule("limit", require=dsl.root("team").text().eq_text("team-0"))), "id").withColumn("resource_fingerprint", F.col("resource_id"))
    waived = governance.apply_waivers(out.join(df.selectExpr("cast(id as string) as resource_id", "name"), "resource_id"), [Waiver("w", "p", "limit", "name", "svc-7", NOW - DAY, NOW + DAY)], NOW, {"name": F.col("name")})
    assert waived.where("waiver_state = 'WAIVED'").count() == 1 and waived.where("waiver_state = 'ACTIVE'").count() == 18
    v = governance.verdicts(waived, "SHADOW").first()
    assert (v.verdict, v.violating_rules, v.denies, v.would_deny) == ("VIOLATED", 1, False, True)


def test_differences(spark):
    from verdictframe.cli import document_diff

    old = dsl.policy_set("s", dsl.policy("p", LIMIT(5), dsl.rule("sev", require=dsl.root("a").number().eq(1), severity="INFO"), dsl.rule("gone", require=dsl.root("a").number().eq(2)), dsl.rule("t", require=dsl.root("a").text().eq_text("x"))))
    new = dsl.policy_set("s", dsl.policy("p", LIMIT(20), dsl.rule("sev", require=dsl.root("a").number().eq(1), severity="ERROR"), dsl.rule("t", require=dsl.root("a").number().eq(1)), dsl.rule("fresh", require=dsl.root("zz").number().eq(1))))
    tree = {"spec": {"replicas": number(9)}, "a": number(1)}
    entries = document_diff(interpreter.evaluate(old, tree), interpreter.evaluate(new, tree))
    assert {(e["ruleId"], e["category"]) for e in entries} == {("limit", "RESOLVED_VIOLATION"), ("sev", "SEVERITY_CHANGED"), ("gone", "RESOLVED_VIOLATION"), ("t", "ERROR_RESOLVED"), ("fresh", "NEW_VIOLATION")}
    df = spark.createDataFrame([(1, (9,), 1)], "id long, spec struct<replicas:int>, a int")
    fp = interpreter.digest_of(tree)
    a, b = (evaluate.evaluate(df, x, "id").withColumn("resource_fingerprint", F.lit(fp)) for x in (old, new))
    got = {(r.rule_id, r.category, r.fingerprint) for r in governance.diff_reports(a, b).collect()}
    assert got == {(e["ruleId"], e["category"], e["fingerprint"]) for e in entries}
    other = b.withColumn("resource_fingerprint", F.lit("x"))
    assert governance.mismatched_corpora(a, other).count() == 1
    assert [(r.resource_id, r.rule_id, r.category) for r in governance.diff_reports(a, other).collect()] == [("1", None, "CORPUS_MISMATCH")]
    assert len(governance.diff_digest(governance.diff_reports(a, b)).first().diff_digest) == 64


def test_row_digests_agree_with_documents(spark):
    df = spark.createDataFrame([("a\n\"q\\", 5, True, None), ("😀", -1, False, "x")], "t string, n long, b boolean, u string")
    got = [r.f for r in df.select(evaluate.row_fingerprint(df).alias("f")).collect()]
    assert got == [interpreter.digest_of({"t": t, "n": number(n), "b": b, "u": u}) for t, n, b, u in [("a\n\"q\\", 5, True, None), ("😀", -1, False, "x")]]
    rules = dsl.policy_set("s😀", dsl.policy("p", dsl.rule("n", require=dsl.root("n").number().gt(0)), dsl.rule("t", require=dsl.root("t").number().gt(0)), dsl.rule("o", require=dsl.optional_root("zz").number().gt(0))))
    out = evaluate.evaluate(df, rules, "t").join(df.select(F.col("t").alias("resource_id"), evaluate.row_fingerprint(df).alias("resource_fingerprint")), "resource_id")
    digests = {r.resource_id: r.report_digest for r in evaluate.report_digest(out).collect()}
    assert digests == {r.resource_id: r.report_digest for r in evaluate.report_digests(df, rules, "t", evaluate.row_fingerprint(df)).collect()}
    for t, n, b, u in [("a\n\"q\\", 5, True, None), ("😀", -1, False, "x")]:
        assert digests[t] == interpreter.evaluate(rules, {"t": t, "n": number(n), "b": b, "u": u}).digest


def test_findings_of_rows_have_the_fields_of_documents(spark):
    import json

    from verdictframe.operators import findings

    df = spark.createDataFrame([(1, 9, "a\n\"é"), (2, 9, "b"), (3, 1, "c")], "id long, replicas int, name string")
    results = evaluate.evaluate(df.selectExpr("id", "name", "struct(replicas) as spec"), layer("s", LIMIT(5)), "id", keep={"name": "name"}).withColumn("resource_fingerprint", F.sha2("name", 256))
    found = findings.findings(results, F.col("resource_id"))
    rows = {r.resource_id: r for r in found.collect()}
    want = [findings.Finding(r.policy_id, r.rule_id, r.resource_id, r.state, r.fingerprint, r.message, r.policy_set_id, r.path, r.actual, r.expected, None, "digest", "t.csv") for r in rows.values()]
    got = [r.value for r in findings.to_jsonl(found, "digest", "t.csv").collect()]
    assert len(got) == 2 and sorted(map(json.loads, got), key=str) == sorted(map(json.loads, findings.render(want, "jsonl").split("\n")), key=str)
    assert all(list(json.loads(g)) == list(json.loads(findings.render(want[:1], "jsonl"))) for g in got)
