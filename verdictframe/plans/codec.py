"""Rules as canonical JSON, with limits on what is read, and bundles that carry them."""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation

from verdictframe.plans.ir import (
    COLLECTION_OPS, MISSING, NUMBER_KINDS, OPERATORS, SEVERITIES, TAGS, Authority, CollectionPredicate, Comparison, DatasetRef, Expression, FieldRef, Literal, Not, Num, Policy, PolicySet, Reference,
    Refusal, Rule, Selector, Supersession, dotted, tag, utf16_order,
)

#: Limits of what is admitted; fixed values.
MAX_IR_BYTES, MAX_DEPTH, MAX_NODES, MAX_RULES, MAX_SELECTOR_DEPTH = 16 << 20, 128, 200_000, 10_000, 256
MAX_PACK_BYTES, MAX_ENTRY_BYTES, MAX_NAME_BYTES = 32 << 20, 16 << 20, 256
MAGIC = b"PKB1"
ENTRIES = ("manifest.json", "metadata.txt", "policy-source-map.txt", "policy.ir.json")
_LAYER_ORDER = ("PLATFORM", "ORGANIZATION", "PROJECT", "PIPELINE_LOCAL")


@dataclass(frozen=True)
class SourceRef:
    file: str
    start_line: int
    start_column: int
    end_line: int
    end_column: int
    symbol: str


@dataclass(frozen=True)
class Shape:
    path: str
    type: str
    authority: str


@dataclass(frozen=True)
class Document:
    """A policy set with what travels with it."""

    policies: PolicySet
    functions: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    shapes: tuple[Shape, ...] = ()
    source_refs: dict[str, SourceRef] = field(default_factory=dict)
    language: str = "m3"
    version: int = 1


def _corrupt(message: str) -> Refusal:
    return Refusal("CORRUPT_ENCODING", message)


# writing


def quote(text: str) -> str:
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def _flag(b: bool) -> str:
    return "true" if b else "false"


def _object(*pairs: tuple[str, str | None]) -> str:
    return "{" + ",".join(f"{quote(k)}:{v}" for k, v in pairs if v is not None) + "}"


def _list(items) -> str:
    return "[" + ",".join(items) + "]"


def _sorted(mapping: dict) -> list:
    return sorted(mapping.items(), key=lambda kv: utf16_order(kv[0]))


def write_value(v: object) -> str:
    kind = tag(v)
    if kind == "NUMBER":
        if not v.finite:
            raise _corrupt(f"non-finite {v.kind} is not JSON encodable")
        return _object(("type", quote(kind)), ("numberKind", quote(v.kind)), ("value", quote(str(v))))
    body = {"TEXT": lambda: quote(v), "BOOLEAN": lambda: _flag(v), "SEQUENCE": lambda: _list(map(write_value, v)), "MAPPING": lambda: _object(*[(k, write_value(x)) for k, x in _sorted(v)])}.get(kind, lambda: "null")()
    return _object(("type", quote(kind)), ("value", body))


def write_selector(s: Selector) -> str:
    return _object(("segments", _list(map(quote, s.path))), ("expectedType", "null" if s.expected is None else quote(s.expected)), ("optional", _flag(s.optional)))


def write_expression(e: Expression, legacy: bool = False) -> str:
    w = lambda x: write_expression(x, legacy)
    if isinstance(e, Literal):
        return _object(("op", quote("literal")), ("value", write_value(e.value)))
    if isinstance(e, FieldRef):
        where = ("path", quote(dotted(e.path))) if legacy else ("segments", _list(map(quote, e.path)))
        return _object(("op", quote("fieldRef")), where, ("type", quote(e.expected)), ("optional", _flag(e.optional)))
    if isinstance(e, Comparison):
        return _object(("op", quote("comparison")), ("operator", quote(e.op)), ("left", w(e.left)), ("right", w(e.right)))
    if isinstance(e, Not):
        return _object(("op", quote("not")), ("body", w(e.body)))
    if isinstance(e, CollectionPredicate):
        return _object(("op", quote("collection")), ("kind", quote(e.op)), ("source", w(e.source)), ("predicate", write_selector(e.predicate)))
    return _object(("op", quote("datasetRef" if isinstance(e, DatasetRef) else "reference")), ("name", quote(e.name)))


def write_parameter(v: object) -> str:
    if isinstance(v, Num):
        kind = v.kind if v.kind in ("INT", "LONG", "DOUBLE") else "LONG" if v.integral else "DOUBLE"
        return _object(("kind", quote(kind)), ("value", quote(str(v))))
    return _object(("kind", quote("BOOLEAN" if isinstance(v, bool) else "STRING")), ("value", _flag(v) if isinstance(v, bool) else quote(v)))


def _write_parameters(p: dict) -> str | None:
    return _object(*[(k, write_parameter(v)) for k, v in _sorted(p)]) if p else None


def _write_supersession(s: Supersession) -> str:
    authority = _object(("issuer", quote(s.authority.issuer)), ("grantedLayers", _list(quote(x) for x in sorted(s.authority.layers, key=_LAYER_ORDER.index))), ("grantDigest", quote(s.authority.digest)))
    target = _object(("policyId", quote(s.policy_id)), ("ruleId", quote(s.rule_id)))
    return _object(("supersedes", target), ("reason", quote(s.reason)), ("authority", authority), ("scope", quote(s.scope)), ("validity", quote(s.validity)))


def _write_rule(r: Rule, legacy: bool) -> str:
    text = lambda v: None if v is None else quote(v)
    return _object(
        ("id", quote(r.id)), ("message", quote(r.message)), ("expression", write_expression(r.expression, legacy)), ("appliesWhen", None if r.applies_when is None else write_expression(r.applies_when, legacy)),
        ("code", text(r.code)), ("expected", text(r.expected)), ("actual", text(r.actual)), ("params", _write_parameters(r.params)),
        ("supersession", None if r.supersession is None else _write_supersession(r.supersession)), ("severity", text(r.severity)),
    )


def encode(d: Document, legacy: bool = False) -> bytes:
    """The canonical bytes of a document; `legacy` writes paths with dots, as the first version did."""
    ordered = sorted(d.policies.policies, key=lambda p: utf16_order(p.id))
    policies = _list(_object(("id", quote(p.id)), ("rules", _list(_write_rule(r, legacy) for r in sorted(p.rules, key=lambda r: utf16_order(r.id))))) for p in ordered)
    shapes = _list(_object(("path", quote(s.path)), ("type", quote(s.type)), ("authority", quote(s.authority))) for s in sorted(d.shapes, key=lambda s: (utf16_order(s.path), utf16_order(s.authority))))
    refs = _object(*[
        (k, _object(("file", quote(r.file)), ("startLine", str(r.start_line)), ("startColumn", str(r.start_column)), ("endLine", str(r.end_line)), ("endColumn", str(r.end_column)), ("symbol", quote(r.symbol))))
        for k, r in _sorted(d.source_refs)
    ])
    return _object(
        ("irVersion", str(d.version)), ("languageVersion", quote(d.language)), ("policySetId", quote(d.policies.id)), ("functions", _list(map(quote, sorted(d.functions, key=utf16_order)))),
        ("parameters", _write_parameters(d.parameters)), ("shapes", shapes if d.shapes else None), ("policies", policies), ("sourceRefs", refs if d.source_refs else None),
    ).encode()


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def semantic_digest(d: Document) -> str:
    """A digest of what the rules mean: parameters, shapes and sources left out."""
    return sha256(encode(replace(d, parameters={}, shapes=(), source_refs={})))


# reading


def _parse(raw: bytes, max_depth: int, max_nodes: int) -> object:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise _corrupt("canonical IR is not valid UTF-8") from e
    depth = deepest = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    if deepest > max_depth:
        raise _corrupt("IR exceeds JSON depth budget")
    nodes = 0

    def pairs(items):
        nonlocal nodes
        nodes += len(items)
        out = dict(items)
        if len(out) < len(items):
            raise _corrupt("duplicate key")
        return out

    def constant(c):
        raise _corrupt(f"invalid number {c}")

    try:
        out = json.loads(text, object_pairs_hook=pairs, parse_float=_Lexical, parse_int=_Lexical, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise _corrupt(f"invalid canonical IR JSON: {e}") from e
    if nodes > max_nodes:
        raise _corrupt("IR exceeds JSON node budget")
    return out


class _Lexical(str):
    """A number as it was written."""


def _need(obj: object, key: str) -> object:
    if not isinstance(obj, dict):
        raise _corrupt("object expected")
    if key not in obj:
        raise _corrupt(f"missing {key}")
    return obj[key]


def _text(v: object) -> str:
    if not isinstance(v, str) or isinstance(v, _Lexical):
        raise _corrupt("string expected")
    return v


def _array(v: object) -> list:
    if not isinstance(v, list):
        raise _corrupt("array expected")
    return v


def _bool(v: object) -> bool:
    if not isinstance(v, bool):
        raise _corrupt("boolean expected")
    return v


def _int(v: object) -> int:
    try:
        return int(v if isinstance(v, str) else "")
    except ValueError as e:
        raise _corrupt("integer expected") from e


def _one_of(v: object, known: tuple | dict) -> str:
    if _text(v) not in known:
        raise _corrupt(f"unknown name {v}")
    return v


def _maybe(obj: dict, key: str, read):
    return None if obj.get(key) is None else read(obj[key])


def read_number(text: object, kind: str | None) -> Num:
    if not isinstance(text, str):
        raise _corrupt("number expected")
    try:
        if kind is None:
            if any(c in text for c in ".eE"):
                kind = "DOUBLE"
            else:
                value = int(text)
                return Num(value, "LONG" if -(1 << 63) <= value < 1 << 63 else "BIG_INTEGER")
        if kind not in NUMBER_KINDS:
            raise _corrupt("unknown numeric carrier")
        out = Num(Decimal(text) if kind == "BIG_DECIMAL" else float(text) if kind in ("DOUBLE", "FLOAT") else int(text), kind)
    except (ValueError, InvalidOperation) as e:
        raise _corrupt(f"invalid number {text}") from e
    bits = {"BYTE": 7, "SHORT": 15, "INT": 31, "LONG": 63}.get(kind)
    if not out.finite or (bits and not -(1 << bits) <= out.value < 1 << bits):
        raise _corrupt(f"{kind} out of range")
    return out


def read_value(v: object) -> object:
    kind = _one_of(_need(v, "type"), TAGS)
    if kind == "MISSING":
        return MISSING
    if kind == "NULL":
        return None
    body = _need(v, "value")
    if kind == "NUMBER":
        return read_number(body, _maybe(v, "numberKind", _text))
    if kind == "SEQUENCE":
        return [read_value(x) for x in _array(body)]
    if kind == "MAPPING":
        return {k: read_value(x) for k, x in (body.items() if isinstance(body, dict) else _need(body, ""))}
    return _text(body) if kind == "TEXT" else _bool(body)


def _path(segments: object) -> tuple[str, ...]:
    out = tuple(map(_text, _array(segments)))
    if len(out) > MAX_SELECTOR_DEPTH:
        raise _corrupt("IR exceeds selector depth budget")
    return out


def _dotted_path(text: object) -> tuple[str, ...]:
    return _path([s for s in _text(text).split(".") if s])


def read_selector(v: object) -> Selector:
    if isinstance(v, str):
        return Selector(_dotted_path(v))
    expected = _maybe(v, "expectedType", lambda x: _one_of(x, TAGS)) if isinstance(v, dict) else None
    return Selector(_path(_need(v, "segments")), expected, v.get("optional") is True)


def read_expression(v: object) -> Expression:
    op = _text(_need(v, "op"))
    if op == "literal":
        return Literal(read_value(_need(v, "value")))
    if op == "fieldRef":
        path = _path(v["segments"]) if v.get("segments") is not None else _dotted_path(_need(v, "path"))
        return FieldRef(path, _one_of(_need(v, "type"), TAGS), _bool(v.get("optional", False)))
    if op == "comparison":
        return Comparison(read_expression(_need(v, "left")), _one_of(_need(v, "operator"), OPERATORS), read_expression(_need(v, "right")))
    if op == "not":
        return Not(read_expression(_need(v, "body")))
    if op == "collection":
        return CollectionPredicate(_one_of(_need(v, "kind"), COLLECTION_OPS), read_expression(_need(v, "source")), read_selector(_need(v, "predicate")))
    if op in ("datasetRef", "reference"):
        return (DatasetRef if op == "datasetRef" else Reference)(_text(_need(v, "name")))
    raise Refusal("UNSUPPORTED_EXPRESSION", f"unknown opcode {op}")


def read_parameter(v: object) -> object:
    if not isinstance(v, dict):  # an early form of rule parameters
        if isinstance(v, _Lexical):
            return read_number(v, "DOUBLE")
        if isinstance(v, (str, bool)):
            return v
        raise _corrupt("legacy rule parameter must be primitive")
    kind, raw = _text(_need(v, "kind")), _need(v, "value")
    if kind in ("INT", "LONG", "DOUBLE"):
        return read_number(_text(raw), kind)
    if kind in ("STRING", "BOOLEAN"):
        return _text(raw) if kind == "STRING" else _bool(raw)
    raise _corrupt("unknown parameter kind")


def _read_supersession(v: dict) -> Supersession:
    target, claim = _need(v, "supersedes"), _need(v, "authority")
    if isinstance(claim, str):
        raise _corrupt("supersession.authority must be an object {issuer, grantedLayers, grantDigest}; a bare string grants nothing")
    authority = Authority(_text(_need(claim, "issuer")), frozenset(_one_of(x, _LAYER_ORDER) for x in _array(_need(claim, "grantedLayers"))), _text(_need(claim, "grantDigest")))
    return Supersession(_text(_need(target, "policyId")), _text(_need(target, "ruleId")), _text(_need(v, "reason")), authority, _text(_need(v, "scope")), _text(_need(v, "validity")))


def _read_rule(v: dict) -> Rule:
    return Rule(
        _text(_need(v, "id")), _text(_need(v, "message")), read_expression(_need(v, "expression")), _maybe(v, "appliesWhen", read_expression), _maybe(v, "code", _text), _maybe(v, "expected", _text),
        _maybe(v, "actual", _text), {k: read_parameter(p) for k, p in (v.get("params") or {}).items()}, _maybe(v, "supersession", _read_supersession), _maybe(v, "severity", lambda s: _one_of(s, SEVERITIES)),
    )


def decode(raw: bytes) -> Document:
    """A document from JSON bytes, within the limits."""
    if len(raw) > MAX_IR_BYTES:
        raise _corrupt("canonical IR exceeds encoded byte budget")
    root = _parse(raw, MAX_DEPTH, MAX_NODES)
    version = _int(_need(root, "irVersion"))
    if version != 1:
        raise _corrupt(f"unsupported IR version {version}")
    policies = _array(_need(root, "policies"))
    if sum(len(_array(_need(p, "rules"))) for p in policies) > MAX_RULES:
        raise _corrupt("IR exceeds rule budget")
    refs = {k: SourceRef(_text(_need(r, "file")), *(_int(_need(r, n)) for n in ("startLine", "startColumn", "endLine", "endColumn")), _text(_need(r, "symbol"))) for k, r in (root.get("sourceRefs") or {}).items()}
    return Document(
        PolicySet(_text(_need(root, "policySetId")), tuple(Policy(_text(_need(p, "id")), tuple(map(_read_rule, p["rules"]))) for p in policies)),
        tuple(map(_text, _array(_need(root, "functions")))), {k: read_parameter(p) for k, p in (root.get("parameters") or {}).items()},
        tuple(Shape(_text(_need(s, "path")), _one_of(_need(s, "type"), TAGS), _text(_need(s, "authority"))) for s in root.get("shapes") or []), refs, _text(_need(root, "languageVersion")), version,
    )


def _references(e: Expression) -> list[Expression]:
    inner = {Not: lambda: [e.body], Comparison: lambda: [e.left, e.right], CollectionPredicate: lambda: [e.source]}.get(type(e), list)()
    return [e, *(x for i in inner for x in _references(i))]


def lower(policies: PolicySet, functions: tuple[str, ...] = (), shapes: tuple[Shape, ...] = ()) -> Document:
    """A checked document: ids and names are not blank, and no top-level field contradicts a declared shape."""
    if not policies.id.strip():
        raise Refusal("INVALID_POLICY", "policy set id must not be blank")
    tops = [e for _, r in policies.rules() for e in (r.expression, r.applies_when) if e is not None]
    for e in (x for t in tops for x in _references(t)):
        if isinstance(e, (Reference, DatasetRef)) and not e.name.strip():
            raise Refusal("INVALID_POLICY", f"empty {'parameter' if isinstance(e, Reference) else 'dataset'} reference")
    for s in shapes:
        if not s.path.strip() or not s.authority.strip():
            raise Refusal("SHAPE_CONTRADICTION", "invalid shape constraint")
        for e in tops:
            if isinstance(e, FieldRef) and dotted(e.path) == s.path and e.expected != s.type:
                raise Refusal("SHAPE_CONTRADICTION", f"shape {s.path} contradicts {e.expected}")
    return Document(policies, tuple(sorted(functions, key=utf16_order)), {}, tuple(sorted(shapes, key=lambda s: (s.path, s.authority))))


# bundles


def _metadata(metadata: dict[str, str]) -> bytes:
    for k, v in metadata.items():
        if not k or any(c in k for c in "=\n\r") or any(c in v for c in "\n\r"):
            raise Refusal("CORRUPT_BUNDLE", "metadata must be single-line text with keys without '='")
    return "\n".join(f"{k}={v}" for k, v in _sorted(metadata)).encode()


def _source_map(d: Document) -> bytes:
    return "\n".join(f"{k}={r.file}:{r.start_line}:{r.start_column}-{r.end_line}:{r.end_column}:{r.symbol}" for k, r in _sorted(d.source_refs)).encode()


def _manifest(d: Document, semantic: str, artifact: str) -> bytes:
    return _object(("bundleId", quote(d.policies.id)), ("bundleVersion", quote("1")), ("semanticDigest", quote(semantic)), ("artifactDigest", quote(artifact)), ("requiredFunctions", _list(map(quote, sorted(d.functions)))), ("irVersion", str(d.version))).encode()


def pack(d: Document, metadata: dict[str, str] | None = None) -> bytes:
    meta, ir = _metadata(metadata or {}), encode(d)
    entries = {"manifest.json": _manifest(d, semantic_digest(d), sha256(ir + meta)), "metadata.txt": meta, "policy-source-map.txt": _source_map(d), "policy.ir.json": ir}
    return MAGIC + b"".join(struct.pack(">i", len(n)) + n.encode() + struct.pack(">q", len(b)) + b for n, b in sorted(entries.items()))


def _refuse_unless(ok: bool, message: str) -> None:
    if not ok:
        raise Refusal("CORRUPT_BUNDLE", message)


def unpack(raw: bytes, capabilities: frozenset[str] = frozenset()) -> tuple[Document, dict[str, str], str]:
    """(document, metadata, semantic digest) of a bundle whose every byte is what packing it again gives."""
    _refuse_unless(len(raw) <= MAX_PACK_BYTES, "packed bundle exceeds byte budget")
    _refuse_unless(raw[:4] == MAGIC, "invalid pack magic")
    at, entries, names = 4, {}, []
    for _ in ENTRIES:
        _refuse_unless(at + 4 <= len(raw), "truncated entry name length")
        size = struct.unpack_from(">i", raw, at)[0]
        at += 4
        _refuse_unless(1 <= size <= MAX_NAME_BYTES and at + size + 8 <= len(raw), "truncated entry")
        try:
            name = raw[at : at + size].decode()
        except UnicodeDecodeError as e:
            raise Refusal("CORRUPT_BUNDLE", "invalid UTF-8 entry name") from e
        at += size
        length = struct.unpack_from(">q", raw, at)[0]
        at += 8
        _refuse_unless(0 <= length <= min(MAX_ENTRY_BYTES, len(raw) - at), "entry exceeds byte budget or pack bounds")
        _refuse_unless(name not in entries, "duplicate entry name")
        entries[name] = raw[at : at + length]
        names.append(name)
        at += length
    _refuse_unless(at == len(raw) and tuple(names) == ENTRIES, "invalid entry set, order, or trailing bytes")
    ir = entries["policy.ir.json"]
    try:
        d = decode(ir)
    except Refusal as e:
        raise Refusal("CORRUPT_BUNDLE", str(e)) from e
    metadata: dict[str, str] = {}
    try:
        lines = entries["metadata.txt"].decode().split("\n") if entries["metadata.txt"] else []
    except UnicodeDecodeError as e:
        raise Refusal("CORRUPT_BUNDLE", "invalid UTF-8") from e
    for line in lines:
        key, sign, value = line.partition("=")
        _refuse_unless(bool(sign and key) and key not in metadata, "invalid or duplicate metadata line")
        metadata[key] = value
    semantic, artifact = semantic_digest(d), sha256(ir + _metadata(metadata))
    if ir != encode(d):
        collections = any(isinstance(x, CollectionPredicate) for _, r in d.policies.rules() for e in (r.expression, r.applies_when) if e is not None for x in _references(e))
        _refuse_unless(not collections and ir == encode(d, legacy=True), "IR bytes do not match a supported canonical encoding")
        _refuse_unless(entries["manifest.json"] == _manifest(d, sha256(ir), artifact), "manifest differs from canonical recalculated manifest")
    else:
        _refuse_unless(entries["manifest.json"] == _manifest(d, semantic, artifact), "manifest differs from canonical recalculated manifest")
    _refuse_unless(entries["policy-source-map.txt"] == _source_map(d), "source map differs from canonical IR source references")
    _refuse_unless(entries["metadata.txt"] == _metadata(metadata), "metadata is not canonical or contains duplicate keys")
    if missing := [f for f in d.functions if f not in capabilities]:
        raise Refusal("UNSUPPORTED_FUNCTION", ", ".join(missing))
    return d, metadata, semantic


def shape_summary(d: Document) -> dict[str, int]:
    rules = d.policies.rules()
    return {"policies": len(d.policies.policies), "rules": len(rules), "rulesWithParams": sum(bool(r.params) for _, r in rules), "functions": len(d.functions), "shapeConstraints": len(d.shapes)}
