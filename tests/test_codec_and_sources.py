"""Canonical JSON, bundles, decoders, the command line and the governed check."""

import base64
import json
import struct
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdictframe import cli
from verdictframe.operators.check_step import policy_check
from verdictframe.operators.findings import decode_event
from verdictframe.plans import codec, dsl
from verdictframe.plans.ir import NUMBER, CollectionPredicate, Comparison, FieldRef, Literal, Not, Num, Policy, PolicySet, Refusal, Rule, Selector, number
from verdictframe.sources import decoders
from verdictframe.sources.decoders import DecodeRefusal

OWNER = dsl.rule("owner", require=dsl.root("metadata").field("owner").text().eq_text("platform"), message="owner must be platform")
REPLICAS = dsl.rule("replicas", require=dsl.root("spec").field("replicas").number().lte(5), severity="ERROR", params={"max": 5})
DOCUMENT = codec.lower(dsl.policy_set("svc", dsl.policy("b", REPLICAS), dsl.policy("a", OWNER, dsl.rule("list", require=dsl.all_of(FieldRef(("x", "y.z"), "SEQUENCE"), dsl.select("value", expected=NUMBER))))))


def test_canonical_bytes():
    d = codec.Document(PolicySet("s", (Policy("p", (Rule("r", "m\n", Comparison(FieldRef(("a", "b.c"), NUMBER, True), "GTE", Literal(Num(Decimal("1.50"), "BIG_DECIMAL")))),)),)))
    want = (
        '{"irVersion":1,"languageVersion":"m3","policySetId":"s","functions":[],"policies":[{"id":"p","rules":[{"id":"r","message":"m\\n","expression":{"op":"comparison","operator":"GTE",'
        '"left":{"op":"fieldRef","segments":["a","b.c"],"type":"NUMBER","optional":true},"right":{"op":"literal","value":{"type":"NUMBER","numberKind":"BIG_DECIMAL","value":"1.50"}}}}]}]}'
    )
    assert codec.encode(d).decode() == want and codec.encode(codec.decode(want.encode())).decode() == want


def test_round_trip_sorts():
    raw = codec.encode(DOCUMENT)
    assert codec.encode(codec.decode(raw)) == raw and raw.index(b'"id":"a"') < raw.index(b'"id":"b"')
    assert codec.semantic_digest(codec.decode(raw)) == codec.semantic_digest(DOCUMENT)


def test_first_version_paths_are_admitted():
    raw = (
        b'{"irVersion":1,"languageVersion":"m5","policySetId":"old","functions":[],"policies":[{"id":"policy","rules":[{"id":"rule","message":"m",'
        b'"expression":{"op":"fieldRef","path":"spec.replicas","type":"NUMBER","optional":false}}]}]}'
    )
    d = codec.decode(raw)
    assert d.policies.rules()[0][1].expression == FieldRef(("spec", "replicas"), NUMBER) and codec.encode(d, legacy=True) == raw
    manifest = codec._manifest(d, codec.sha256(raw), codec.sha256(raw))
    entries = [(b"manifest.json", manifest), (b"metadata.txt", b""), (b"policy-source-map.txt", b""), (b"policy.ir.json", raw)]
    packed = codec.MAGIC + b"".join(struct.pack(">i", len(n)) + n + struct.pack(">q", len(b)) + b for n, b in entries)
    assert codec.unpack(packed)[0] == d


@pytest.mark.parametrize(
    "raw",
    [b"", b"{}", b"[1]", b"\xff", b'{"irVersion":2,"policies":[]}', codec.encode(DOCUMENT)[:-1], codec.encode(DOCUMENT).replace(b'"irVersion":1', b'"irVersion":1,"irVersion":1'), codec.encode(DOCUMENT).replace(b"GTE", b"LIKE").replace(b"LTE", b"LIKE"), b"[" * 200 + b"]" * 200, b'{"irVersion":1,"policySetId":"s","languageVersion":"m","functions":[],"policies":[{"id":"p","rules":[{"id":"r","message":"m","expression":{"op":"matches"}}]}]}'],
)
def test_corrupt_rules_are_refused(raw):
    with pytest.raises(Refusal):
        codec.decode(raw)


def test_lowering_checks():
    with pytest.raises(Refusal):
        codec.lower(dsl.policy_set(" ", dsl.policy("p", OWNER)))
    field = dsl.policy_set("s", dsl.policy("p", dsl.rule("r", require=FieldRef(("a",), NUMBER))))
    with pytest.raises(Refusal):
        codec.lower(field, shapes=(codec.Shape("a", "TEXT", "x"),))
    assert codec.lower(field, shapes=(codec.Shape("a", NUMBER, "x"),)).shapes


def test_bundles():
    packed = codec.pack(DOCUMENT, {"team": "x=y"})
    d, metadata, digest = codec.unpack(packed)
    assert metadata == {"team": "x=y"} and digest == codec.semantic_digest(DOCUMENT) and codec.pack(d, metadata) == packed
    for bad in (packed[:-1], packed + b"x", b"PKB2" + packed[4:], packed.replace(b"team", b"tea\n"), packed.replace(b"platform", b"plotform"), packed.replace(b'"bundleVersion":"1"', b'"bundleVersion":"2"')):
        with pytest.raises(Refusal):
            codec.unpack(bad)
    wants = codec.lower(dsl.policy_set("s", dsl.policy("p", OWNER)), functions=("f",))
    with pytest.raises(Refusal):
        codec.unpack(codec.pack(wants))
    assert codec.unpack(codec.pack(wants), frozenset({"f"}))[0].functions == ("f",)


literals = st.recursive(st.one_of(st.text(max_size=6), st.booleans(), st.none(), st.integers(-(2**70), 2**70).map(number), st.decimals(allow_nan=False, allow_infinity=False, places=2).map(number), st.floats(allow_nan=False, allow_infinity=False).map(number)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=4), x, max_size=3)), max_leaves=6)
bodies = st.recursive(
    st.one_of(literals.map(Literal), st.builds(FieldRef, st.lists(st.text(max_size=4), max_size=3).map(tuple), st.sampled_from(["TEXT", "NUMBER"]), st.booleans())),
    lambda e: st.one_of(st.builds(Not, e), st.builds(Comparison, e, st.sampled_from(["EQ", "TEXT_EQUALS"]), e), st.builds(CollectionPredicate, st.sampled_from(["ALL", "COUNT"]), e, st.builds(Selector, st.lists(st.text(max_size=4), max_size=2).map(tuple), st.sampled_from([None, "TEXT"]), st.booleans()))), max_leaves=5,
)


@settings(max_examples=80, deadline=None)
@given(bodies)
def test_any_expression_survives(e):
    d = codec.Document(PolicySet("s", (Policy("p", (Rule("r", "m", e),)),)))
    raw = codec.encode(d)
    assert codec.encode(codec.decode(raw)) == raw


def test_json():
    value = decoders.decode_json(b' {"n": 42, "d": 4.50, "e": 1e2, "b": 9999999999999999999, "t": "\\u00e9", "l": [true, null]} trailing')[0].root
    assert value == {"n": number(42), "d": Num(Decimal("4.50"), "BIG_DECIMAL"), "e": Num(Decimal("1e2"), "BIG_DECIMAL"), "b": Num(9999999999999999999, "BIG_INTEGER"), "t": "é", "l": [True, None]}
    for raw, code in ((b'{"a":1,"a":3}', "DUPLICATE_KEY"), (b'{"o":{"x":1,"x":2}}', "DUPLICATE_KEY"), (b"", "MALFORMED"), (b"{", "MALFORMED"), (b"[1,]", "MALFORMED"), (b"{'a':1}", "MALFORMED"), (b"\xff", "MALFORMED"), (b"nul", "MALFORMED")):
        with pytest.raises(DecodeRefusal) as e:
            decoders.decode_json(raw)
        assert e.value.code == code
    deep = b'{"a":' * 500 + b"1" + b"}" * 500
    assert decoders.decode_json(deep)[0].root
    d = decoders.decode_json(b'{"a": 1,\n "b": [2,\n 3]}')[0]
    assert decoders.anchor_of(d, ("b", "1")) == ("textSpan", 3, 2) and decoders.anchor_of(d, ("a",)) == ("textSpan", 1, 7) and decoders.anchor_of(d, ("zz",)) is None


def test_json_lines():
    assert [r for _, r in decoders.jsonl_rows(b'{"a":1}\r\n\n{"a":2}')] == [{"a": number(1)}, {"a": number(2)}]
    for raw in (b'{"a":1} x', b"[1]", b"  \n", b'{"a":1,"a":2}'):
        with pytest.raises(DecodeRefusal):
            list(decoders.jsonl_rows(raw))


def test_csv():
    rows = lambda raw: [r for _, r in decoders.csv_rows(raw)]
    assert rows(b'temp,unit\n21,c\r\n"22,5",c\r"say ""hi""","a\nb"') == [{"temp": "21", "unit": "c"}, {"temp": "22,5", "unit": "c"}, {"temp": 'say "hi"', "unit": "a\nb"}]
    assert rows(b"n,n\na,b\n") == [{"n": "b"}] and rows("é,😀\nü,x".encode()) == [{"é": "ü", "😀": "x"}]
    for raw in (b"", b"temp\nok\n1,2\n", b'a\n"open'):
        with pytest.raises(DecodeRefusal):
            rows(raw)
    assert decoders.decode_csv(b"a,b\n1\n1,2,3\n")[0].root == [{"a": "1", "b": ""}, {"a": "1", "b": "2"}]
    assert [d.id for d in decoders.decode_csv(b"a\n1\n2\n", each_row=True)] == ["csv://row-2", "csv://row-3"] and decoders.decode_csv(b"a\n")[0].root == []
    for raw, options, code in ((b"name,name\na,b\n", {}, "DUPLICATE_KEY"), (b"a\n", {"each_row": True}, "MALFORMED"), (b"n,c\na,1\nb,2\nc,3\nd,not_a_number\n", {"infer_sample": 3}, "SCHEMA_FROZEN")):
        with pytest.raises(DecodeRefusal) as e:
            decoders.decode_csv(raw, **options)
        assert e.value.code == code
    assert e.value.anchor == "cell(5,2)" and decoders.infer_kind(["1", "", "null"]) == "LONG" and decoders.infer_kind(["1.5", "2"]) == "DECIMAL" and decoders.infer_kind(["True"]) == "BOOLEAN" and decoders.infer_kind([""]) == "NULL"


def test_yaml():
    docs = decoders.decode_yaml(b"a: 1\nb: 0x1F\nc: 1.50\nd: .inf\ne: 'true'\nf: yes\ng: ~\nh: True\n---\n- x\n")
    assert docs[0].root == {"a": number(1), "b": "0x1F", "c": Num(Decimal("1.50"), "BIG_DECIMAL"), "d": ".inf", "e": "true", "f": "yes", "g": None, "h": True} and docs[1].root == ["x"] and docs[1].id == "yaml://document-1"
    bomb = "a: &a [x]\n" + "".join(f"k{i}: *a\n" for i in range(101))
    for raw, code in ((b"a: 1\na: 2", "DUPLICATE_KEY"), (b"", "MALFORMED"), (b"[1", "MALFORMED"), (b"? [1]\n: 2", "UNSUPPORTED_HOST_VALUE"), (bomb.encode(), "ALIAS_EXPANSION_EXCEEDED")):
        with pytest.raises(DecodeRefusal) as e:
            decoders.decode_yaml(raw)
        assert e.value.code == code
    from verdictframe.functions.interpreter import digest_of

    assert digest_of(decoders.decode_yaml(b"b: 2\na: 1")[0].root) == digest_of(decoders.decode_json(b'{"a":1,"b":2}')[0].root)


def test_host_maps():
    assert decoders.decode_map({"a": (1, 2.5, "x", None, True)}).root == {"a": [number(1), number(2.5), "x", None, True]}
    for host in ({1: 2}, {"a": {1, 2}}, {"a": object()}):
        with pytest.raises(DecodeRefusal):
            decoders.decode_map(host)


def test_readers(spark, tmp_path):
    from verdictframe.sources import readers

    (tmp_path / "a.json").write_text('{"n": 1.50}')
    (tmp_path / "b.yaml").write_text("n: 1\n---\nn: 2\n")
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.txt").write_text("x")
    (tmp_path / "e.json").write_text('"' + "x" * 200 + '"')
    rows = {(r.path.rpartition("/")[2], r.resource_id.rpartition("/")[2]): (r.doc, r.refusal) for r in readers.read_documents(spark, str(tmp_path), budget=100).collect()}
    assert rows["a.json", "document"] == ('{"n":1.50}', None) and len(rows) == 6 and rows["c.json", "c.json"][1] == "MALFORMED" and rows["d.txt", "d.txt"][1] == "UNSUPPORTED_HOST_VALUE" and rows["e.json", "e.json"][1] == "TOO_LARGE"
    df = spark.createDataFrame([(base64.b64encode(b"x" * n).decode(),) for n in (5, 10, 30)] + [("!!",), (None,)], "p string")
    assert [r.admission for r in readers.admit_encoded(df, "p", 10).collect()] == ["OK", "OK", "TOO_LARGE", "MALFORMED", "MALFORMED"]


@pytest.fixture
def bundle(tmp_path):
    ir = tmp_path / "rules.json"
    ir.write_bytes(codec.encode(codec.lower(dsl.policy_set("svc", dsl.policy("p", OWNER, REPLICAS)))))
    out = tmp_path / "rules.bundle"
    assert cli.main(["compile", "--ir", str(ir), "--out", str(out)]) == 0
    return out


def run(*argv):
    lines = []
    return cli.main([str(a) for a in argv], lines.append), "\n".join(lines)


def test_command_line(bundle, tmp_path):
    good, bad, wrong = (tmp_path / f"{n}.json" for n in ("x.allow", "y.deny", "z"))
    good.write_text('{"spec":{"replicas":2},"metadata":{"owner":"platform"}}')
    bad.write_text('{"spec":{"replicas":9},"metadata":{"owner":"nobody"}}')
    wrong.write_text('{"spec":{"replicas":"2"},"metadata":{"owner":"platform"}}')
    assert run("check", "--policy", bundle, good) == (0, "no findings")
    code, text = run("check", "--policy", bundle, bad, "--format", "json")
    assert code == 2 and json.loads(text)["summary"]["total"] == 2 and json.loads(text)["findings"][0]["severity"] == "error"
    assert run("check", "--policy", bundle, "--enforcement", "shadow", bad)[0] == 0 and run("check", "--policy", bundle, "--enforcement", "shadow", wrong)[0] == 3
    assert run("check", "--policy", bundle, tmp_path / "none.json")[0] == 4 and run("check", "--policy", bundle)[0] == 1 and run("check", good)[0] == 1 and run("nonsense")[0] == 1
    assert run("test", "--policy", bundle, "--fixtures", tmp_path)[0] == 0 and run("inspect", "--policy", bundle)[0] == 0 and run("bundle", "--verify", bundle)[0] == 0
    assert json.loads(run("shape", "--policy", bundle)[1]) == {"policies": 1, "rules": 2, "rulesWithParams": 1, "functions": 0, "shapeConstraints": 0}
    assert "VIOLATED" in run("explain", "--policy", bundle, "--rule", "owner", "--resource", bad)[1] and run("explain", "--policy", bundle, "--rule", "zz")[0] == 1
    assert run("diff", "--a", bundle, "--b", bundle, good)[0] == 0 and run("diff", "--a", bundle, "--b", bundle, good, bad)[0] == 3
    (tmp_path / "broken.bundle").write_bytes(bundle.read_bytes()[:-3])
    assert run("check", "--policy", tmp_path / "broken.bundle", good)[0] == 4
    (tmp_path / "broken.json").write_text("{")
    assert run("compile", "--ir", tmp_path / "broken.json", "--out", tmp_path / "o")[0] == 5


def test_streams_from_the_command_line(spark, tmp_path):
    out = tmp_path / "t.bundle"
    out.write_bytes(codec.pack(codec.lower(dsl.policy_set("s", dsl.policy("p", dsl.rule("temp", require=dsl.root("temp").text().eq_text("ok")))))))
    csv, ragged, lines = tmp_path / "t.csv", tmp_path / "r.csv", tmp_path / "t.jsonl"
    csv.write_text("temp\nok\nbad\nok\nworse\n")
    ragged.write_text("temp\nok\n1,2\n")
    lines.write_text('{"temp":"ok"}\n{"temp":"bad"}\n')
    code, text = run("stream", "--policy", out, csv)
    assert code == 2 and text == "stream: violations=2 (last row 4)"
    assert run("stream", "--policy", out, csv, lines) == (2, "stream: violations=3 (last row 2)")
    assert json.loads(run("stream", "--policy", out, "--format-out", "json", lines, csv)[1]) == {"status": "violations", "violations": 3, "lastViolationRow": 4}
    assert json.loads(run("stream", "--policy", out, "--format-out", "json", csv, ragged)[1])["status"] == "decode-refusal"
    assert run("stream", "--policy", out, lines)[0] == 2 and run("stream", "--policy", out, ragged)[0] == 4
    assert run("stream", "--policy", out, "--row-budget", "2", csv)[0] == 3 and run("stream", "--policy", out, "--row-budget", "0", csv)[0] == 1 and run("stream", "--policy", out, tmp_path / "none.csv")[0] == 4


def test_governed_check():
    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    b64 = lambda raw: base64.b64encode(raw).decode()
    packed = b64(codec.pack(DOCUMENT))
    ok = policy_check(b64(b'{"spec":{"replicas":9},"metadata":{"owner":"platform"},"x":{"y.z":[1]}}'), "JSON", packed, now, enforcement="SHADOW")
    assert (ok.verdict, ok.violating_rules, ok.would_deny, ok.denies) == ("VIOLATED", 1, True, False) and decode_event(ok.event)["digest"] == ok.report_digest
    for resource, form, bundle, code in (("!", "JSON", packed, "RESOURCE_NOT_BASE64"), (b64(b"{}"), "TOML", packed, "UNKNOWN_FORMAT"), (b64(b"{}"), "JSON", b64(b"x"), "CORRUPT_BUNDLE"), (b64(b"{"), "JSON", packed, "MALFORMED"), (b64(b"a: 1\n---\nb: 2"), "YAML", packed, "MULTI_DOCUMENT_RESOURCE")):
        assert policy_check(resource, form, bundle, now).refusal == code
    assert policy_check(b64(b"{}" * 99), "JSON", packed, now, budget=10).refusal == "RESOURCE_TOO_LARGE"
