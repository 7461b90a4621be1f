"""Row files of any size, read in splits by many tasks, with the row numbers and refusals of one reader that goes through the whole file.

A split of Spark's line reader begins after a line end, so a CSV reader is there in one of two states: at the start of a row, or inside a
quoted cell. A first pass finds for each split where both lead and how many rows end on the way; the states and the numbers of rows before
each split then follow in order, from a row for each split. A second pass parses every split from its own state. A row that several
splits share is put together from their parts. No task holds more than a stretch of lines and one row.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions.storage import materialize
from verdictframe.sources import decoders
from verdictframe.sources.decoders import MALFORMED, TOO_LARGE, DecodeRefusal

#: Bytes of lines that are parsed at once.
STRETCH = 4 << 20
ROWS = "path string, row_no long, row string, refusal string, anchor string"
_PARTS = "path string, row_no long, row string, refusal string, anchor string, block long, part binary"
_SPLITS = "path string, block long, lines long, bytes long, free_end boolean, free_rows long, quoted_end boolean, quoted_rows long, header string"
_QUOTED_END = re.compile(rb'"(?:[^"]|"")*+"')


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, block (where its split begins) and value (bytes of a line, without its line feed), in the order of the file within a split."""
    lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _stretches(batches):
    """(path, block, lines) of stretches of lines of one split, in order."""
    key, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block, values = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        runs = {int(x) for x in pc.run_end_encode(path).run_ends.to_pylist()} | {i + 1 for i in range(len(block) - 1) if block[i] != block[i + 1]} if path[0] != path[-1] or block[0] != block[-1] else {len(block)}
        at = 0
        for end in sorted(runs):
            here = (path[at].as_py(), int(block[at]))
            if here != key or size > STRETCH:
                if held:
                    yield *key, held
                key, held, size = here, [], 0
            held += values[at:end]
            size += sum(map(len, values[at:end]))
            at = end
    if held:
        yield *key, held


def _is_plain(raw: bytes) -> bool:
    """Whether every line is a row: no quotes, and no carriage return but before a line feed."""
    return b'"' not in raw and (b"\r" not in raw or b"\r" not in raw.replace(b"\r\n", b"\n"))


def _close(raw: bytes) -> int:
    """Where the rest of a quoted cell ends, after its closing quote; -1 if it doesn't."""
    m = _QUOTED_END.match(b'"' + raw)
    return -1 if m is None else m.end() - 1


def _rest_of_row(raw: bytes, at: int) -> int:
    """Where a row ends (before its line end) whose quoted cell ended at `at`; -1 if a later cell stays open."""
    if raw[at : at + 1] != b",":
        return at
    try:
        return decoders._csv_row(raw, at + 1)[1]
    except DecodeRefusal:
        return -1


def _after_line_end(raw: bytes, at: int) -> int:
    return at + (2 if raw[at : at + 2] == b"\r\n" else raw[at : at + 1] in (b"\r", b"\n"))


class _CsvReader:
    """Goes through the stretches of a split from one of the two states; keeps what is open."""

    def __init__(self, quoted: bool) -> None:
        self.open = b'"' if quoted else b""  # the row that is open, as far as it matters
        self.from_before, self.rows = quoted, 0

    def add(self, raw: bytes):
        """Whole rows of cells that end within these bytes, which end with a line feed; a row that began before the split is None."""
        raw = self.open + raw
        self.open, at = b"", 0
        if self.from_before:
            end = _close(raw[1:])
            end = -1 if end < 0 else _rest_of_row(raw, end + 1)
            if end < 0:
                self.open = b'"'  # inside a quoted cell of that row; its text is not needed
                return
            self.from_before, self.rows = False, self.rows + 1
            yield None, _after_line_end(raw, end) - 1
            at = _after_line_end(raw, end)
        while at < len(raw):
            try:
                cells, end = decoders._csv_row(raw, at)
            except DecodeRefusal:
                self.open = raw[at:]
                return
            self.rows += 1
            yield cells, 0
            at = _after_line_end(raw, end)


def _survey(batches):
    """A row of _SPLITS for each split: what both states lead to."""
    key, free, quoted, lines, size, header = None, None, None, 0, 0, None

    def give():
        return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in _SPLITS.split(", ")], (*key, lines, size, bool(free.open), free.rows, bool(quoted.open), quoted.rows, header)))], schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("bytes", pa.int64()), ("free_end", pa.bool_()), ("free_rows", pa.int64()), ("quoted_end", pa.bool_()), ("quoted_rows", pa.int64()), ("header", pa.string())]))

    for path, block, values in _stretches(batches):
        if (path, block) != key:
            if key is not None:
                yield give()
            key, free, quoted, lines, size, header = (path, block), _CsvReader(False), _CsvReader(True), 0, 0, None
        lines, size = lines + len(values), size + sum(map(len, values)) + len(values)
        raw = b"\n".join(values) + b"\n"
        plain = _is_plain(raw)
        if plain and not free.open and not (block == 0 and header is None):
            free.rows += len(values)
        else:
            for cells, _ in free.add(raw):
                if block == 0 and header is None:
                    header = json.dumps(cells)
        if quoted.from_before and b'"' not in raw:
            pass  # still inside the cell; its text doesn't matter here
        elif plain and not quoted.open:
            quoted.rows += len(values)
        else:
            for _ in quoted.add(raw):
                pass
    if key is not None:
        yield give()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _PARTS.split(", ")])


def _csv_parts(states: dict[tuple[str, int], tuple[bool, int]], headers: dict[str, list[str]]):
    """_PARTS rows: whole rows as JSON or refusals, and parts of the rows that reach over splits."""

    def row(path: str, n: int, cells: list[str]) -> tuple:
        header = headers[path]
        if len(cells) != len(header):
            return (path, n, None, MALFORMED, f"csv://ragged-row@{n}", None, None)
        return (path, n, json.dumps(dict(zip(header, cells)), ensure_ascii=False, separators=(",", ":")), None, None, None, None)

    def run(batches):
        key, reader, base, offset = None, None, 0, 0

        def tail():
            return [(key[0], base + reader.rows, None, None, None, key[1], reader.open)] if reader.open and not reader.from_before else []

        for path, block, values in _stretches(batches):
            if path not in headers:
                continue  # refused already
            out = []
            if (path, block) != key:
                if key is not None:
                    out += tail()
                key, offset = (path, block), block
                quoted, base = states[key]
                reader = _CsvReader(quoted)
            raw = b"\n".join(values) + b"\n"
            if not reader.open and _is_plain(raw):
                for n, line in enumerate(values, base + reader.rows):
                    if n:
                        out.append(row(path, n, line.removesuffix(b"\r").decode("utf-8", "replace").split(",")))
                reader.rows += len(values)
            else:
                before = reader.from_before
                for cells, upto in reader.add(raw):
                    if cells is None:  # the rest of the row that was open
                        out.append((path, base, None, None, None, offset, raw[:upto]))
                        before = False
                    elif base + reader.rows - 1 > 0:
                        out.append(row(path, base + reader.rows - 1, cells))
                if before:
                    out.append((path, base, None, None, None, offset, raw))
            offset += len(raw)
            if out:
                yield _table(out)
        if key is not None and (rest := tail()):
            yield _table(rest)

    return run


def _mended(headers: dict[str, list[str]]):
    def run(frames):
        for pdf in frames:
            out = []
            for path, n, parts in zip(pdf["path"], pdf["row_no"], pdf["parts"]):
                cells, _ = decoders._csv_row(b"".join(bytes(p["part"]) for p in parts), 0)
                header = headers[path]
                if n == 0:
                    continue
                if len(cells) != len(header):
                    out.append((path, n, None, MALFORMED, f"csv://ragged-row@{n}"))
                else:
                    out.append((path, n, decoders.to_json(dict(zip(header, cells))), None, None))
            yield pd.DataFrame(out, columns=["path", "row_no", "row", "refusal", "anchor"])

    return run


def _csv(spark: SparkSession, files: dict[str, int]) -> tuple[DataFrame, list[tuple]]:
    """Rows of CSV files, and the refusals that are known without them. `files`: length by path."""
    with _same_splits(spark):
        return _csv_in_splits(spark, files)


@contextmanager
def _same_splits(spark: SparkSession):
    """Two passes over files are split alike inside, even if executors come or go between them; a split that the first didn't see is an error."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _follow(surveyed: list[dict], files: dict[str, int]) -> tuple[dict[tuple[str, int], tuple[bool, int]], dict[str, list[str]], list[tuple], dict[str, int]]:
    """From the surveys of all splits: of each its state and the rows before it, the files' headers, refusals (path, row number, code,
    anchor), and for files that end inside a quoted cell the number of the row that stays open."""
    splits: dict[str, list[dict]] = {}
    for r in surveyed:
        splits.setdefault(r["path"], []).append(r)
    states, headers, refused, open_rows = {}, {}, [], {}
    for path, rows in splits.items():
        quoted, base = False, 0
        rows.sort(key=lambda r: r["block"])
        for r in rows:
            states[path, r["block"]] = (quoted, base)
            quoted, base = (r["quoted_end"], base + r["quoted_rows"]) if quoted else (r["free_end"], base + r["free_rows"])
        if rows[0]["header"] is not None:
            headers[path] = json.loads(rows[0]["header"])
        if quoted:
            read = sum(r["bytes"] for r in rows)
            newlines = sum(r["lines"] for r in rows) - (read > files[path])  # the last line may have no line feed
            open_rows[path] = base
            refused.append((path, max(base, 1), MALFORMED, f"csv://unterminated-quote@{newlines + 1}"))
        elif rows[0]["header"] is None:  # it is longer than a split
            refused.append((path, 1, TOO_LARGE, "csv://header"))
    return states, headers, refused, open_rows


def _csv_in_splits(spark: SparkSession, files: dict[str, int]) -> tuple[DataFrame, list[tuple]]:
    lines = _lines(spark, list(files))
    states, headers, refused, open_rows = _follow([r.asDict() for r in lines.mapInArrow(_survey, _SPLITS).collect()], files)  # a row for each split
    refused += [(path, 1, TOO_LARGE, "csv://header") for path in open_rows if path not in headers and open_rows[path] > 0]
    parts = materialize(lines.mapInArrow(_csv_parts(states, headers), _PARTS), "rows")
    pieces = parts.where("part is not null")
    for path, n in open_rows.items():  # a cell that is never closed is no row, however long it is
        pieces = pieces.where(~((F.col("path") == path) & (F.col("row_no") >= n)))
    grouped = pieces.groupBy("path", "row_no").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    whole = parts.where("part is null").select("path", "row_no", "row", "refusal", "anchor")
    return whole.unionByName(grouped.mapInPandas(_mended(headers), ROWS)), refused


def _jsonl_part(batches):
    """Lines that aren't empty, numbered within their split, as rows or refusals; an anchor has {n} for the row's number."""
    key, n = None, 0
    for path, block, values in _stretches(batches):
        if (path, block) != key:
            key, n = (path, block), 0
        out = []
        for line in values:
            line = line.replace(b"\r", b"")
            if not line:
                continue
            n += 1
            try:
                value = decoders.jsonl_row(line)
                out.append((path, n, decoders.to_json(value), None, None, block, None))
            except DecodeRefusal as e:
                out.append((path, n, None, e.code, e.anchor, block, None))
        if out:
            yield _table(out)


def _jsonl(spark: SparkSession, files: dict[str, int]) -> DataFrame:
    parts = materialize(_lines(spark, list(files)).mapInArrow(_jsonl_part, _PARTS), "rows")
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in parts.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each split
        counts.setdefault(r.path, []).append((r.block, r.n))
    bases = []
    for path, found in counts.items():
        base = 0
        for block, n in sorted(found):
            bases.append((path, block, base))
            base += n
    side = F.broadcast(spark.createDataFrame(bases, "path string, block long, base long"))
    number = F.col("row_no") + F.col("base")
    anchor = F.when(F.startswith("anchor", F.lit("jsonl://line-")), F.replace("anchor", F.lit("{n}"), number.cast("string"))).otherwise(F.col("anchor"))
    return parts.join(side, ["path", "block"]).select("path", number.alias("row_no"), "row", "refusal", anchor.alias("anchor"))


def read_rows(spark: SparkSession, path: str | list[str], *, budget: int | None = None, kind: str | None = None) -> DataFrame:
    """ROWS of CSV and JSON-lines files of any size, numbered from 1 in each file; the row at which a file is refused has the refusal
    instead, and the rows after it don't come. A file above a `budget`, if one is given, is refused as TOO_LARGE; an empty CSV file is refused.

    The format is that of the extension unless `kind` names it. Lines are split at line feeds by Spark's reader; a split may have any size.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = [(r["path"], r["name"], r["length"]) for r in files.select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("name"), "length").collect()]
    # a scan leaves empty files out
    short = lambda uri: unquote(uri).replace("file:///", "file:/", 1)
    seen = {short(uri) for uri, _, _ in listed}
    listed += [(uri, short(uri), 0) for uri in files.inputFiles() if short(uri) not in seen]
    refused: list[tuple] = []  # path, row number, code, anchor
    forms: dict[str, dict[str, int]] = {"CSV": {}, "JSONL": {}}
    for uri, name, length in listed:
        try:
            form = kind or decoders.format_of(name, decoders.STREAM_FORMATS)
        except DecodeRefusal as e:
            refused.append((uri, 1, e.code, e.anchor))
            continue
        if budget is not None and length > budget:
            refused.append((uri, 1, TOO_LARGE, None))
        elif length == 0:
            if form == "CSV":
                refused.append((uri, 1, MALFORMED, "csv://empty"))
        else:
            forms["CSV" if form == "CSV" else "JSONL"][uri] = length
    found = [spark.createDataFrame([(p, n, None, code, anchor) for p, n, code, anchor in refused], ROWS)] if refused else []
    if forms["CSV"]:
        rows, more = _csv(spark, forms["CSV"])
        found.append(rows)
        refused += more
        if more:
            found.append(spark.createDataFrame([(p, n, None, code, anchor) for p, n, code, anchor in more], ROWS))
    if forms["JSONL"]:
        found.append(_jsonl(spark, forms["JSONL"]))
    if not found:
        return spark.createDataFrame([], ROWS)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # the first refusal of a file ends it
    names = spark.createDataFrame([(uri, name) for uri, name, _ in listed], "path string, name string")
    first = rows.where("refusal is not null").groupBy("path").agg(F.min("row_no").alias("stop"))
    ended = rows.join(names.join(first, "path", "left"), "path").where("stop is null or row_no < stop or (row_no = stop and refusal is not null)")
    return ended.select(F.col("name").alias("path"), "row_no", "row", "refusal", "anchor")
