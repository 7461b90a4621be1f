"""Row files in small splits against one reader over the whole file."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from verdictframe.sources import decoders, splits
from verdictframe.sources.readers import read_rows


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "157", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(raw: bytes, kind: str):
    out, n = [], 0
    try:
        for n, row in decoders.csv_rows(raw) if kind == "CSV" else decoders.jsonl_rows(raw):
            out.append((n, decoders.to_json(row), None, None))
    except decoders.DecodeRefusal as e:
        out.append((n + 1, None, e.code, e.anchor))
    return out


def cell(rng: random.Random) -> str:
    if rng.random() < 0.6:
        return rng.choice(["", "a", "bb ", "é中", "1.5", 'x"y', "\t"])
    return '"' + "".join(rng.choice(["a", ",", "\n", "\r\n", '""', "\r", "ü", "\n\n"]) for _ in range(rng.choice([0, 2, 5, 40]))) + '"'


def csv_text(rng: random.Random, kind: int) -> bytes:
    width = rng.choice([1, 2, 3])
    end = rng.choice(["\n", "\r\n", "\r"])
    rows = [",".join("hdr"[i] for i in range(width))] + [",".join(cell(rng) for _ in range(width)) for _ in range(rng.randrange(60))]
    if kind == 1:
        rows.insert(rng.randrange(1, len(rows) + 1), "too,many,cells,here")
    if kind == 2:
        rows.insert(rng.randrange(1, len(rows) + 1), 'z,"never closed' if width > 1 else '"never closed')
    if kind == 3:
        rows.insert(rng.randrange(1, len(rows) + 1), "bad \udc80 bytes" + ",x" * (width - 1))
    return (end.join(rows) + rng.choice(["", end, end + end])).encode("utf-8", "surrogateescape")


def jsonl_text(rng: random.Random, kind: int) -> bytes:
    rows = [rng.choice(['{"a": 1}', '{"a": {"b": [1.50, "é"]}}', "", "\r", '{"x": null} ']) for _ in range(60)]
    if kind:
        rows.insert(rng.randrange(60), ["", "[1]", '{"a":1} 2', '{"a":1,"a":2}', "{nope", "\udcff"][kind])
    return (rng.choice(["\n", "\r\n"]).join(rows) + rng.choice(["", "\n"])).encode("utf-8", "surrogateescape")


def in_splits(raw: bytes, size: int, rng: random.Random):
    """Rows of a CSV text by the passes over splits, without Spark: a split has the lines that begin within it."""
    lines, at = [], 0
    for line in raw.removesuffix(b"\n").split(b"\n"):
        lines.append(("p", 0 if at == 0 else (at - 1) // size * size, line))
        at += len(line) + 1

    def feed():
        at = 0
        while at < len(lines):
            part = lines[at : at + rng.randint(1, 4)]
            at += len(part)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.binary()))], ["path", "block", "value"])

    surveyed = [r for b in splits._survey(feed()) for r in b.to_pylist()]
    states, headers, refused, open_rows = splits._follow(surveyed, {"p": len(raw)})
    parts = [r for b in splits._csv_parts(states, headers)(feed()) for r in b.to_pylist()]
    rows = [(r["row_no"], r["row"], r["refusal"], r["anchor"]) for r in parts if r["part"] is None] + [(n, None, code, anchor) for _, n, code, anchor in refused]
    pieces: dict[int, list] = {}
    for r in parts:
        if r["part"] is not None and r["row_no"] < open_rows.get("p", 1 << 62):
            pieces.setdefault(r["row_no"], []).append({"block": r["block"], "part": r["part"]})
    frame = pd.DataFrame([("p", n, sorted(x, key=lambda y: y["block"])) for n, x in pieces.items()], columns=["path", "row_no", "parts"])
    rows += [(int(n), row, code, anchor) for f in splits._mended(headers)(iter([frame])) for _, n, row, code, anchor in f.itertuples(index=False)]
    stop = min((r[0] for r in rows if r[2]), default=1 << 62)
    return sorted((r for r in rows if r[0] < stop or (r[0] == stop and r[2])), key=lambda r: r[0])


@pytest.mark.parametrize("stretch", [1, 40, 10_000])
def test_splits_of_any_size_give_what_one_reader_gives(stretch, monkeypatch):
    monkeypatch.setattr(splits, "STRETCH", stretch)
    rng, same = random.Random(stretch), 0
    for i in range(24):
        raw = csv_text(rng, i % 4)
        for size in (7, 60, 5000):
            got = in_splits(raw, size, rng)
            if [r[2] for r in got] != ["TOO_LARGE"]:  # the header is longer than a split
                assert got == whole(raw, "CSV")
                same += 1
    assert same > 50


def test_an_escaped_quote_at_the_end_closes_nothing():
    assert whole(b'a,b\n1,"x""', "CSV") == [(1, None, "MALFORMED", "csv://unterminated-quote@2")]


def test_splits_give_what_one_reader_gives(spark, tmp_path, small_splits):
    rng, want = random.Random(9), {}
    for i in range(3):
        for ext, raw in (("csv", csv_text(rng, i)), ("jsonl", jsonl_text(rng, i))):
            (tmp_path / f"f{i}.{ext}").write_bytes(raw)
            want[f"f{i}.{ext}"] = whole(raw, ext.upper())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    want |= {"empty.csv": [(1, None, "MALFORMED", "csv://empty")], "empty.jsonl": []}
    got: dict[str, list] = {name: [] for name in want}
    for r in read_rows(spark, str(tmp_path)).collect():
        got[r.path.rsplit("/", 1)[1]].append((r.row_no, r.row, r.refusal, r.anchor))
    assert {name: sorted(rows, key=lambda r: r[0]) for name, rows in got.items()} == want


def test_a_header_longer_than_a_split_is_refused(spark, tmp_path, small_splits):
    (tmp_path / "h.csv").write_text('"' + "a\n" * 120 + '",b\n1,2\n')
    assert [(r.row_no, r.refusal, r.anchor) for r in read_rows(spark, str(tmp_path / "h.csv")).collect()] == [(1, "TOO_LARGE", "csv://header")]


def test_files_above_a_budget_are_refused_and_never_empty(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("a,b\n" + "1,2\n" * 100)
    path = str(tmp_path / "rows.csv")
    assert read_rows(spark, path).count() == 100
    assert [(r.row_no, r.row, r.refusal) for r in read_rows(spark, path, budget=10).collect()] == [(1, None, "TOO_LARGE")]


def test_a_file_of_64_mib_streams_to_its_last_row(spark, tmp_path):
    import json

    from verdictframe import cli
    from verdictframe.plans import codec, dsl

    rules = dsl.policy_set("big", dsl.policy("p", dsl.rule("region", require=dsl.root("region").text().eq_text("region-0"))))
    (tmp_path / "b.bundle").write_bytes(codec.pack(codec.lower(rules)))
    line, rows = "r{0},region-{1},some notes that make the row about as long as rows are,{0}\n", 0
    with open(tmp_path / "big.csv", "w") as f:
        f.write("id,region,notes,again\n")
        while f.tell() < 65 << 20:
            f.write("".join(line.format(i, i % 8) for i in range(rows, rows + 10_000)))
            rows += 10_000
    said: list[str] = []
    code = cli.main(["stream", "--policy", str(tmp_path / "b.bundle"), "--format-out", "json", str(tmp_path / "big.csv")], said.append)
    assert code == 2 and json.loads(said[-1]) == {"status": "violations", "violations": rows - rows // 8, "lastViolationRow": rows}
