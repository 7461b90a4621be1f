"""Rules as data: expressions, rules, policies, and the values that literals hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

#: Type tags of values; fixed names.
MISSING_TAG, NULL, TEXT, NUMBER, BOOLEAN, SEQUENCE, MAPPING = "MISSING", "NULL", "TEXT", "NUMBER", "BOOLEAN", "SEQUENCE", "MAPPING"
TAGS = (MISSING_TAG, NULL, TEXT, NUMBER, BOOLEAN, SEQUENCE, MAPPING)
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
#: Violation codes, in the order that digests sort by; fixed names.
CODES = ("MISSING_REQUIRED_VALUE", "TYPE_MISMATCH", "COMPARISON_FAILED", "COLLECTION_PREDICATE_FAILED")
#: Comparison operators and how diagnostics write them; fixed names and signs.
OPERATORS = {"EQ": "=", "NEQ": "!=", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<=", "TEXT_EQUALS": "==text", "BOOLEAN_EQUALS": "==bool"}
COLLECTION_OPS = ("COUNT", "ALL", "ANY", "NONE")
#: Kinds of numbers; fixed names.
INTEGRAL_KINDS = ("BYTE", "SHORT", "INT", "LONG", "BIG_INTEGER")
NUMBER_KINDS = (*INTEGRAL_KINDS, "BIG_DECIMAL", "FLOAT", "DOUBLE")


class Refusal(ValueError):
    """Something that the engine won't run, with a typed code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class _Missing:
    def __repr__(self) -> str:
        return "Missing"

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


@dataclass(frozen=True)
class Num:
    """A number with the kind it was written as; 1, 1.0 and 1.50 are different values that compare by amount."""

    value: int | float | Decimal
    kind: str = "LONG"

    def __str__(self) -> str:
        return java_float(float(self.value)) if self.kind in ("DOUBLE", "FLOAT") else str(self.value)

    @property
    def integral(self) -> bool:
        return self.kind in INTEGRAL_KINDS

    @property
    def finite(self) -> bool:
        return not isinstance(self.value, float) or (self.value == self.value and abs(self.value) != float("inf"))

    def exact(self) -> int | Decimal:
        """The amount without rounding; a double counts as its exact binary value."""
        return Decimal(self.value) if isinstance(self.value, float) else self.value


def java_float(x: float) -> str:
    """A double as a JVM prints it: plain from 0.001 up to ten million, else with an exponent."""
    if x != x:
        return "NaN"
    if abs(x) == float("inf"):
        return "Infinity" if x > 0 else "-Infinity"
    sign, digits, exp = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exp
    if x == 0:
        out = "0.0"
    elif 1e-3 <= abs(x) < 1e7:
        whole, frac = ("0", "0" * -point + text) if point <= 0 else (text[:point].ljust(point, "0"), text[point:])
        out = f"{whole}.{frac or '0'}"
    else:
        out = f"{text[0]}.{text[1:] or '0'}E{point - 1}"
    return ("-" if sign else "") + out


def number(x: int | float | Decimal) -> Num:
    if isinstance(x, bool):
        raise TypeError("a boolean is no number")
    if isinstance(x, int):
        return Num(x, "LONG" if -(1 << 63) <= x < 1 << 63 else "BIG_INTEGER")
    return Num(x, "BIG_DECIMAL") if isinstance(x, Decimal) else Num(float(x), "DOUBLE")


def tag(value: object) -> str:
    """The type tag of a value: text str, numbers Num, booleans bool, null None, sequences list, mappings dict."""
    if value is MISSING:
        return MISSING_TAG
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, str):
        return TEXT
    if isinstance(value, Num):
        return NUMBER
    return SEQUENCE if isinstance(value, list) else MAPPING


Path = tuple[str, ...]


def dotted(path: Path) -> str:
    return ".".join(path)


@dataclass(frozen=True)
class Selector:
    path: Path = ()
    expected: str | None = None
    optional: bool = False


class Expression:
    """Base of the closed set of expressions."""


@dataclass(frozen=True)
class Literal(Expression):
    value: object

    def __hash__(self) -> int:
        return hash(repr(self.value))


@dataclass(frozen=True)
class FieldRef(Expression):
    path: Path
    expected: str
    optional: bool = False


@dataclass(frozen=True)
class Comparison(Expression):
    left: Expression
    op: str
    right: Expression


@dataclass(frozen=True)
class Not(Expression):
    body: Expression


@dataclass(frozen=True)
class CollectionPredicate(Expression):
    op: str
    source: Expression
    predicate: Selector


@dataclass(frozen=True)
class DatasetRef(Expression):
    name: str


@dataclass(frozen=True)
class Reference(Expression):
    name: str


@dataclass(frozen=True)
class Authority:
    issuer: str
    layers: frozenset[str]
    digest: str


@dataclass(frozen=True)
class Supersession:
    policy_id: str
    rule_id: str
    reason: str
    authority: Authority
    scope: str = ""
    validity: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    message: str
    expression: Expression
    applies_when: Expression | None = None
    code: str | None = None
    expected: str | None = None
    actual: str | None = None
    params: dict[str, object] = field(default_factory=dict)
    supersession: Supersession | None = None
    severity: str | None = None


@dataclass(frozen=True)
class Policy:
    id: str
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class PolicySet:
    id: str
    policies: tuple[Policy, ...]

    def __post_init__(self) -> None:
        ids = [p.id for p in self.policies]
        if len(set(ids)) < len(ids):
            raise Refusal("DUPLICATE_POLICY_ID", f"policy set {self.id} has a policy id twice")
        for p in self.policies:
            if len({r.id for r in p.rules}) < len(p.rules):
                raise Refusal("DUPLICATE_RULE_ID", f"policy {p.id} has a rule id twice")

    def rules(self) -> list[tuple[str, Rule]]:
        return [(p.id, r) for p in self.policies for r in p.rules]


def utf16_length(text: str) -> int:
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def encode_parts(*parts: str | None) -> str:
    """Each part with its length in UTF-16 units before it; null is -1."""
    return "".join("-1:" if p is None else f"{utf16_length(p)}:{p}" for p in parts)


def rule_key(set_id: str, policy_id: str, rule_id: str) -> str:
    return encode_parts(set_id, policy_id, rule_id)


def utf16_order(text: str) -> bytes:
    """A sort key for the order of UTF-16 units."""
    return text.encode("utf-16-be", "surrogatepass")


def location_of(e: Expression) -> Path:
    if isinstance(e, FieldRef):
        return e.path
    if isinstance(e, Comparison):
        return location_of(e.left)
    if isinstance(e, Not):
        return location_of(e.body)
    return location_of(e.source) if isinstance(e, CollectionPredicate) else ()


def describe_right(e: Expression) -> str | None:
    """How a violation writes a literal on the right of a comparison."""
    if not isinstance(e, Literal):
        return None
    v = e.value
    return str(v) if isinstance(v, Num) else v if isinstance(v, str) else _printed(v)


def _printed(v: object) -> str:
    kind = tag(v)
    if kind == BOOLEAN:
        return f"BooleanValue(boolean={'true' if v else 'false'})"
    if kind == SEQUENCE:
        return f"SequenceValue(elements=[{', '.join(map(_printed, v))}])"
    if kind == MAPPING:
        return "MappingValue(entries={" + ", ".join(f"{k}={_printed(x)}" for k, x in v.items()) + "})"
    return {NULL: "Null", MISSING_TAG: "Missing", TEXT: f"TextValue(text={v})", NUMBER: f"NumberValue(number={v})"}[kind]


def expected_text(rule: Rule) -> str:
    """What a violation of a false expression says was expected."""
    if rule.expected is not None:
        return rule.expected
    e = rule.expression
    if not isinstance(e, Comparison):
        return "null"
    return OPERATORS[e.op] + (describe_right(e.right) or "")


def substitute(e: Expression, params: dict[str, object]) -> Expression:
    """References replaced by the parameters' values, in literals, negations and comparisons; a long parameter becomes a double."""
    if isinstance(e, Reference) and e.name in params:
        v = params[e.name]
        if isinstance(v, Num):
            v = Num(float(v.value), "DOUBLE") if v.kind in ("LONG", "FLOAT") else v
        return Literal(v)
    if isinstance(e, Not):
        return Not(substitute(e.body, params))
    if isinstance(e, Comparison):
        return Comparison(substitute(e.left, params), e.op, substitute(e.right, params))
    return e


_OPPOSITE = {"EQ": "NEQ", "NEQ": "EQ", "GT": "LTE", "LTE": "GT", "GTE": "LT", "LT": "GTE"}


def negate(e: Expression) -> Expression:
    """What `forbid` lowers to: the opposite numeric comparison, or else a negation."""
    return Comparison(e.left, _OPPOSITE[e.op], e.right) if isinstance(e, Comparison) and e.op in _OPPOSITE else Not(e)
