"""JSON, JSON lines, YAML, CSV and host maps as values, with typed refusals and the place of every value in its source.

Values are those of `plans.ir`: numbers keep the digits they were written with. Anchors are listed by node in pre-order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from verdictframe.plans.ir import Num

#: Why a source is refused; fixed names.
MALFORMED, DUPLICATE_KEY, UNSUPPORTED, SCHEMA_FROZEN, ALIAS_EXPANSION = "MALFORMED", "DUPLICATE_KEY", "UNSUPPORTED_HOST_VALUE", "SCHEMA_FROZEN", "ALIAS_EXPANSION_EXCEEDED"
TOO_LARGE = "TOO_LARGE"
ALIAS_CAP = 100
#: File extensions and their formats; fixed names. Nothing is sniffed.
DOCUMENT_FORMATS = {"json": "JSON", "yaml": "YAML", "yml": "YAML", "csv": "CSV"}
STREAM_FORMATS = {"csv": "CSV", "jsonl": "JSONL", "ndjson": "JSONL"}


class DecodeRefusal(ValueError):
    def __init__(self, code: str, anchor: str | None = None) -> None:
        super().__init__(code if anchor is None else f"{code} at {anchor}")
        self.code, self.anchor = code, anchor


@dataclass
class Decoded:
    id: str
    format: str
    root: object
    anchors: list[tuple] = field(default_factory=list)  # (kind, ...) by pre-order node


def format_of(path: str, known: dict[str, str] = DOCUMENT_FORMATS) -> str:
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if ext not in known:
        raise DecodeRefusal(UNSUPPORTED, f"unsupported format .{ext}")
    return known[ext]


# JSON

_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_END = object()


def _number(text: str) -> Num:
    if any(c in text for c in ".eE"):
        return Num(Decimal(text), "BIG_DECIMAL")
    value = int(text)
    return Num(value, "LONG" if -(1 << 63) <= value < 1 << 63 else "BIG_INTEGER")


class _Tokens:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.lines, self.seen, self.start = text, 0, 1, 0, 0

    def position(self, offset: int) -> tuple[int, int]:
        """Line and column, counted from 1; offsets only grow."""
        self.lines += self.text.count("\n", self.seen, offset)
        self.seen = offset
        return self.lines, offset - self.text.rfind("\n", 0, offset)

    def next(self) -> object:
        m = _TOKEN.match(self.text, self.at)
        if m is None:
            if self.text[self.at :].strip(" \t\r\n"):
                raise DecodeRefusal(MALFORMED)
            return _END
        self.start, self.at = m.start(m.lastindex), m.end()
        sign, text, number, word = m.groups()
        if sign:
            return sign
        if text:
            try:
                return (json.loads(text),)
            except ValueError as e:
                raise DecodeRefusal(MALFORMED) from e
        return (_number(number),) if number else ({"true": True, "false": False, "null": None}[word],)


def parse_json(text: str, anchors: list[tuple] | None = None) -> tuple[object, bool]:
    """(value, whether something follows it). No recursion, so depth is bounded by memory only."""
    t = _Tokens(text)
    stack: list[tuple[object, object]] = []  # container, pending key
    result: object = _END

    def put(value: object) -> None:
        nonlocal result
        if not stack:
            result = value
            return
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key] = value

    def begin(offset: int) -> None:
        if anchors is not None:
            anchors.append(("textSpan", *t.position(offset)))

    expect = "value"
    while True:
        token = t.next()
        if token is _END:
            raise DecodeRefusal(MALFORMED)
        if expect in ("value", "value or ]") and (isinstance(token, tuple) or token in ("{", "[")):
            begin(t.start)
            if isinstance(token, tuple):
                put(token[0])
            else:
                box: object = {} if token == "{" else []
                put(box)
                stack.append((box, None))
                expect = "key or }" if token == "{" else "value or ]"
                continue
        elif expect in ("key", "key or }") and isinstance(token, tuple) and isinstance(token[0], str):
            box, _ = stack.pop()
            if token[0] in box:
                raise DecodeRefusal(DUPLICATE_KEY, token[0])
            stack.append((box, token[0]))
            if t.next() != ":":
                raise DecodeRefusal(MALFORMED)
            expect = "value"
            continue
        elif (expect in ("key or }", "after") and token == "}" and isinstance(stack[-1][0], dict)) or (expect in ("value or ]", "after") and token == "]" and isinstance(stack[-1][0], list)):
            stack.pop()
        elif expect == "after" and token == ",":
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        else:
            raise DecodeRefusal(MALFORMED)
        if not stack:
            rest = t.text[t.at :].strip(" \t\r\n")
            return result, bool(rest)
        expect = "after"


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DecodeRefusal(MALFORMED) from e


def decode_json(raw: bytes) -> list[Decoded]:
    """One document; what follows the first value is ignored."""
    anchors: list[tuple] = []
    return [Decoded("json://document", "JSON", parse_json(_utf8(raw), anchors)[0], anchors)]


def jsonl_row(line: bytes) -> dict:
    """The row of a line; one that is no single object is refused, with {n} in the anchor for its number."""
    try:
        value, more = parse_json(_utf8(line))
    except DecodeRefusal as e:
        raise DecodeRefusal(e.code, "jsonl://line-{n}" if e.code == MALFORMED else f"jsonl://duplicate-key:{e.anchor}") from e
    if more or not isinstance(value, dict):
        raise DecodeRefusal(MALFORMED, f"jsonl://line-{{n}}/{'trailing' if more else 'not-an-object'}")
    return value


def jsonl_rows(raw: bytes):
    """(line number, row) of each line that is not empty; a line that is no single object refuses the stream."""
    n = 0
    for line in raw.replace(b"\r", b"").split(b"\n"):
        if not line:
            continue
        n += 1
        try:
            yield n, jsonl_row(line)
        except DecodeRefusal as e:
            raise DecodeRefusal(e.code, e.anchor.replace("{n}", str(n)) if e.anchor.startswith("jsonl://line-") else e.anchor) from e


# CSV

_QUOTED = re.compile(rb'"((?:[^"]|"")*+)"')
_PLAIN = re.compile(rb"[^,\r\n]*")


def _csv_row(raw: bytes, at: int) -> tuple[list[str], int]:
    """The cells of the row that starts at a byte, and where it ends (before its line end)."""
    cells = []
    while True:
        if raw[at : at + 1] == b'"':
            m = _QUOTED.match(raw, at)
            if m is None:
                raise DecodeRefusal(MALFORMED, f"csv://unterminated-quote@{raw.count(b'\n') + 1}")
            cells.append(m[1].replace(b'""', b'"').decode("utf-8", "replace"))
        else:
            m = _PLAIN.match(raw, at)
            cells.append(m[0].decode("utf-8", "replace"))
        at = m.end()
        if raw[at : at + 1] != b",":
            return cells, at
        at += 1


def csv_records(raw: bytes):
    """All rows of cells; text right after a closing quote begins a new row."""
    at = 0
    while at < len(raw):
        cells, at = _csv_row(raw, at)
        yield cells
        at += 2 if raw[at : at + 2] == b"\r\n" else raw[at : at + 1] in (b"\r", b"\n")


def csv_rows(raw: bytes):
    """(row number from 1, mapping) of a row stream: every row must have as many cells as the header; of headers that repeat the last counts."""
    if not raw:
        raise DecodeRefusal(MALFORMED, "csv://empty")
    records = csv_records(raw)
    header = next(records)
    for n, cells in enumerate(records, 1):
        if len(cells) != len(header):
            raise DecodeRefusal(MALFORMED, f"csv://ragged-row@{n}")
        yield n, dict(zip(header, cells))


def _is_long(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?\d+", text, re.ASCII)) and -(1 << 63) <= int(text) < 1 << 63


def _is_decimal(text: str) -> bool:
    try:
        return Decimal(text).is_finite() and text == text.strip() and "_" not in text
    except InvalidOperation:
        return False


def _is_boolean(text: str) -> bool:
    return text.lower() in ("true", "false")


_KINDS = (("BOOLEAN", _is_boolean), ("LONG", _is_long), ("DECIMAL", _is_decimal))


def infer_kind(values: list[str]) -> str:
    """The narrowest kind of a column's sample: BOOLEAN, LONG, DECIMAL, TEXT, or NULL if it has no values."""
    some = [v for v in values if v and v.lower() != "null"]
    return next((k for k, fits in _KINDS if all(map(fits, some))), "TEXT") if some else "NULL"


def fits_kind(value: str, kind: str) -> bool:
    if not value or value.lower() == "null":
        return True
    return kind == "TEXT" or dict(_KINDS).get(kind, lambda _: False)(value)


def decode_csv(raw: bytes, each_row: bool = False, infer_sample: int = 0) -> list[Decoded]:
    """One sequence of rows, or a document for each row. Short rows are filled with empty cells and further cells dropped; cells are text.

    With a sample, kinds are frozen from its rows, and a later cell that breaks its column's kind refuses the source.
    """
    rows = list(csv_records(raw))
    if not rows:
        raise DecodeRefusal(MALFORMED)
    header, data = rows[0], rows[1:]
    for i, name in enumerate(header):
        if name in header[:i]:
            raise DecodeRefusal(DUPLICATE_KEY, f"cell(1,{i + 1})")
    data = [(r + [""] * len(header))[: len(header)] for r in data]
    if infer_sample > 0:
        kinds = [infer_kind([r[i] for r in data[:infer_sample]]) for i in range(len(header))]
        for n, r in enumerate(data, 2):
            for i, (value, kind) in enumerate(zip(r, kinds)):
                if not fits_kind(value, kind):
                    raise DecodeRefusal(SCHEMA_FROZEN, f"cell({n},{i + 1})")
    cells = lambda n: [("cell", n, 1), *(("cell", n, i + 1) for i in range(len(header)))]
    if each_row:
        if not data:
            raise DecodeRefusal(MALFORMED)
        return [Decoded(f"csv://row-{n}", "CSV", dict(zip(header, r)), cells(n)) for n, r in enumerate(data, 2)]
    anchors = [("logical", "csv://document/rows"), *(a for n in range(2, len(data) + 2) for a in cells(n))]
    return [Decoded("csv://document", "CSV", [dict(zip(header, r)) for r in data], anchors)]


# YAML

_YAML_INT = re.compile(r"[-+]?[0-9]+")
_YAML_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
_YAML_NULL = ("null", "Null", "NULL", "~", "")
_YAML_BOOL = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def _yaml_scalar(text: str, plain: bool, explicit: str | None) -> object:
    """A scalar by the core schema; only plain ones are typed. Octal, hexadecimal, infinite and undefined numbers stay text."""
    if explicit == "tag:yaml.org,2002:str" or not (plain or explicit):
        return text
    if text in _YAML_NULL:
        return None
    if text in _YAML_BOOL:
        return _YAML_BOOL[text]
    if _YAML_INT.fullmatch(text):
        return _number(str(int(text)))
    return Num(Decimal(text), "BIG_DECIMAL") if _YAML_FLOAT.fullmatch(text) else text


def decode_yaml(raw: bytes, alias_cap: int = ALIAS_CAP) -> list[Decoded]:
    """A document for each of the stream's, `yaml://document-i`; aliases are followed up to a cap."""
    import yaml

    text = _utf8(raw)
    if not text.strip():
        raise DecodeRefusal(MALFORMED, "yaml://stream")
    try:
        aliases = sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text, Loader=yaml.SafeLoader))
        if aliases > alias_cap:
            raise DecodeRefusal(ALIAS_EXPANSION, "yaml://stream")
        nodes = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise DecodeRefusal(MALFORMED, "yaml://stream") from e

    def value(node, anchors: list, open_nodes: frozenset[int]) -> object:
        if id(node) in open_nodes:
            raise DecodeRefusal(ALIAS_EXPANSION, "yaml://stream")
        mark = node.start_mark
        anchors.append(("textSpan", mark.line + 1, mark.column + 1))
        inner = open_nodes | {id(node)}
        if isinstance(node, yaml.ScalarNode):
            return _yaml_scalar(node.value, node.style is None, None if node.style is None else node.tag if node.tag != "tag:yaml.org,2002:str" else "tag:yaml.org,2002:str")
        if isinstance(node, yaml.SequenceNode):
            return [value(n, anchors, inner) for n in node.value]
        out: dict[str, object] = {}
        for k, v in node.value:
            if not isinstance(k, yaml.ScalarNode):
                raise DecodeRefusal(UNSUPPORTED, "yaml://non-scalar-key")
            if k.value in out:
                raise DecodeRefusal(DUPLICATE_KEY, f"yaml://{k.start_mark.line + 1}:{k.start_mark.column + 1}")
            out[k.value] = value(v, anchors, inner)
        return out

    found = []
    for i, node in enumerate(n for n in nodes if n is not None):
        anchors: list[tuple] = []
        found.append(Decoded(f"yaml://document-{i}", "YAML", value(node, anchors, frozenset()), anchors))
    if not found:
        raise DecodeRefusal(MALFORMED, "yaml://stream")
    return found


# host maps


def decode_map(host: object) -> Decoded:
    """A document from Python values: None, booleans, numbers, text, dicts with text keys, lists and tuples; nothing else."""
    anchors: list[tuple] = []

    def value(v: object, path: str) -> object:
        if v is None or isinstance(v, (bool, str, Num)):
            out: object = v
        elif isinstance(v, int):
            out = Num(v, "LONG" if -(1 << 63) <= v < 1 << 63 else "BIG_INTEGER")
        elif isinstance(v, float):
            out = Num(v, "DOUBLE")
        elif isinstance(v, Decimal):
            out = Num(v, "BIG_DECIMAL")
        elif isinstance(v, dict):
            if not all(isinstance(k, str) for k in v):
                raise DecodeRefusal(UNSUPPORTED, f"map://{path}")
            out = {k: value(x, f"{path}/{k}") for k, x in v.items()}
        elif isinstance(v, (list, tuple)):
            out = [value(x, f"{path}/{i}") for i, x in enumerate(v)]
        else:
            raise DecodeRefusal(UNSUPPORTED, f"map://{path}")
        anchors.append(("logical", f"map://{path}"))  # children first
        return out

    return Decoded("map://document", "MAP_ADAPTER", value(host, ""), anchors)


def decode(raw: bytes, kind: str, **options) -> list[Decoded]:
    return {"JSON": decode_json, "YAML": decode_yaml, "CSV": decode_csv}[kind](raw, **options)


def to_json(value: object) -> str:
    """A value as JSON text with its numbers as they were written."""
    if isinstance(value, Num):
        return str(value) if value.finite else "null"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{to_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(to_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def anchor_of(decoded: Decoded, path: tuple[str, ...]) -> tuple | None:
    """The anchor of the value at a path: nodes are numbered in pre-order, as they were decoded."""
    at, node = 0, decoded.root

    def size(v: object) -> int:
        return 1 + sum(size(x) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    for step in path:
        items = list(node.items()) if isinstance(node, dict) else [(str(i), x) for i, x in enumerate(node)] if isinstance(node, list) else []
        at += 1
        for k, x in items:
            if k == step:
                node = x
                break
            at += size(x)
        else:
            return None
    return decoded.anchors[at] if at < len(decoded.anchors) else None
