"""Rules compiled to columns.

A row is a mapping of its columns. A place in it is resolved as far as the schema tells: a column that is not there is missing, a NULL is
the null value, structs, maps and arrays are descended into, and VARIANT columns carry documents whose types are known only row by row.
Boolean expressions compile to a state (T true, F false, MR required value missing, MO optional value missing, CPF collection predicate
failed, ERR typed refusal) with its diagnostics, never to a nullable boolean, so that SQL's third truth value does not mix them up. What
the schema decides is folded on the driver, and Catalyst prunes the columns that no rule reads.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.functions.storage import free_names
from verdictframe.plans.ir import (
    BOOLEAN, MAPPING, NULL, NUMBER, SEQUENCE, TEXT, CollectionPredicate, Comparison, Expression, FieldRef, Literal, Not, Num, Path, Refusal, Rule, Selector,
    dotted, expected_text, location_of, tag,
)

#: Kinds of VARIANT values by the first word of their schema; fixed names of Spark.
_VARIANT_NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"
#: Numbers of documents are compared with so many digits, and so many of them after the point, unless they are doubles.
_WIDE = T.DecimalType(38, 12)
_BOOL = T.BooleanType()


def tag_of_type(kind: T.DataType) -> str | None:
    """The tag that values of a column type have; None for VARIANT, whose rows differ."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(kind, (T.NumericType,)):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.ArrayType):
        return SEQUENCE
    if isinstance(kind, (T.StructType, T.MapType)):
        return MAPPING
    if isinstance(kind, T.VariantType):
        return None
    if isinstance(kind, T.NullType):
        return NULL
    raise Refusal("UNSUPPORTED_COLUMN_TYPE", f"{kind.simpleString()} has no tag; cast it to text or a number first")


@dataclass(frozen=True)
class Node:
    """A value in a row: its type, its column, and whether it is there at all (None: always). A literal keeps its value."""

    kind: T.DataType
    column: Column
    present: Column | None = None
    literal: object = None
    known: bool = False  # a literal
    tag_column: Column | None = None  # its tag, where that is a column already

    @property
    def variant(self) -> bool:
        return isinstance(self.kind, T.VariantType)

    def tag(self) -> Column | str:
        """The tag as text, if it is the same for all rows that have the value, or as a column."""
        if self.known:
            return tag(self.literal)
        if self.tag_column is not None:
            return self.tag_column
        if self.variant:
            schema = F.schema_of_variant(self.column)
            return (
                F.when(F.is_variant_null(self.column), NULL).when(schema.rlike(_VARIANT_NUMBERS), NUMBER).when(schema == "STRING", TEXT).when(schema == "BOOLEAN", BOOLEAN)
                .when(schema.startswith("ARRAY"), SEQUENCE).when(schema.startswith("OBJECT"), MAPPING).otherwise(NULL)
            )
        return F.when(self.column.isNull(), NULL).otherwise(tag_of_type(self.kind))

    def has(self) -> Column:
        return F.lit(True) if self.present is None else self.present


def _and(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def _index(step: str) -> int | None:
    """A step as a place in a sequence, or None."""
    return int(step) if step.lstrip("+").isascii() and step.lstrip("+").isdigit() and step.count("+") <= 1 else None


def _variant_path(step: str) -> str:
    return "$[" + json.dumps(step, ensure_ascii=False) + "]"


def descend(node: Node | None, path: Path) -> Node | None:
    """The node at a path below another; None where the schema has no such place."""
    for step in path:
        if node is None:
            return None
        kind, column = node.kind, node.column
        if node.variant:
            by_key, i = F.try_variant_get(column, _variant_path(step), "variant"), _index(step)
            found = by_key if i is None else F.coalesce(by_key, F.try_variant_get(column, f"$[{i}]", "variant"))
            node = Node(T.VariantType(), found, _and(node.present, found.isNotNull()))
        elif isinstance(kind, T.StructType):
            if step not in kind.names:
                return None
            node = Node(kind[step].dataType, column.getField(step), _and(node.present, column.isNotNull()))
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            node = Node(kind.valueType, F.try_element_at(column, F.lit(step)), _and(node.present, F.coalesce(F.map_contains_key(column, step), F.lit(False))))
        elif isinstance(kind, T.ArrayType):
            i = _index(step)
            if i is None:
                return None
            node = Node(kind.elementType, F.get(column, F.lit(i)), _and(node.present, F.coalesce(F.size(column) > i, F.lit(False))))
        else:
            return None
    return node


def _state(st: str, code: str | None = None, loc: str | Column = "", msg: str | Column = "", exp: str | None = None, act: str | Column | None = None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(*[as_column(v).alias(n) for n, v in (("st", st), ("code", code), ("loc", loc), ("msg", msg), ("exp", exp), ("act", act))])


def _error(loc: Path, msg: str | Column, exp: str, act: str | Column) -> Column:
    return _state("ERR", "TYPE_MISMATCH", dotted(loc), msg, exp, act)


class _Cases:
    """An ordered choice of states; what the schema decides cuts it short."""

    def __init__(self) -> None:
        self.rows: list[tuple[Column, Column]] = []
        self.closed: Column | None = None

    def add(self, when: Column | bool, state: Column) -> None:
        if self.closed is not None or when is False:
            return
        if when is True:
            self.closed = state
        else:
            self.rows.append((when, state))

    def otherwise(self, last: Column) -> Column:
        end = self.closed if self.closed is not None else last
        if not self.rows:
            return end
        first, *rest = self.rows
        return reduce(lambda c, r: c.when(*r), rest, F.when(*first)).otherwise(end)


def _mapped(state: Column, names: dict[str, str]) -> Column:
    """Another name for each state, with the state's expression in the plan once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), state)


def field_paths(e: Expression) -> list[Path]:
    """The paths of the fields that an expression reads, without those of a collection's elements."""
    if isinstance(e, FieldRef):
        return [tuple(e.path)]
    if isinstance(e, Not):
        return field_paths(e.body)
    if isinstance(e, Comparison):
        return field_paths(e.left) + field_paths(e.right)
    return field_paths(e.source) if isinstance(e, CollectionPredicate) else []


class Compiler:
    """Compiles rules against the schema of a data set's rows, or against a VARIANT column that holds the rows or documents."""

    def __init__(self, schema: T.StructType, document: str | None = None, diagnostics: bool = True) -> None:
        self.schema, self.document = schema, document
        #: Without diagnostics a state is its name alone, which keeps plans of many rules small.
        self.diagnostics = diagnostics
        #: Nodes of paths into VARIANT values that `project` has made columns.
        self.places: dict[Path, Node] = {}

    def project(self, df: DataFrame, *expressions: Expression | None) -> tuple[DataFrame, list[str]]:
        """`df` with a column for the value and the tag of each path into a VARIANT that these expressions read, so that rules which read it
        again don't look for it again; and the names of these columns."""
        paths = [p for e in expressions if e is not None for p in field_paths(e)]
        found = {p: n for p in dict.fromkeys(paths) if (n := self.root(p)) is not None and n.variant and n.present is not None}
        names = free_names(df.columns, *[f"{kind}_{i}" for i in range(len(found)) for kind in ("place", "tag")])
        values, tags = {}, {}
        for (path, node), place, mark in zip(found.items(), names[::2], names[1::2]):
            here = Node(node.kind, F.col(place), F.col(place).isNotNull(), tag_column=F.col(mark))
            values[place], tags[mark], self.places[path] = node.column, Node(node.kind, F.col(place)).tag(), here
        return (df.withColumns(values).withColumns(tags), names) if found else (df, [])

    def state(self, st: str, *details) -> Column:
        return _state(st, *details) if self.diagnostics else F.lit(st)

    def error(self, loc: Path, msg: str | Column, exp: str, act: str | Column) -> Column:
        return _error(loc, msg, exp, act) if self.diagnostics else F.lit("ERR")

    def root(self, path: Path) -> Node | None:
        if path in self.places:
            return self.places[path]
        if self.document is not None:
            return descend(Node(T.VariantType(), F.col(_quoted(self.document))), path)
        if not path:
            return Node(self.schema, F.struct(*[F.col(_quoted(n)) for n in self.schema.names]))
        if path[0] not in self.schema.names:
            return None
        return descend(Node(self.schema[path[0]].dataType, F.col(_quoted(path[0]))), path[1:])

    # values

    def value(self, e: Expression, cases: _Cases) -> Node | None:
        """The node of a value expression; what can go wrong before it goes into `cases`. None if nothing can follow."""
        if isinstance(e, Literal):
            return literal_node(e.value)
        if isinstance(e, FieldRef):
            node = self.root(e.path)
            gone = self.state("MO" if e.optional else "MR", "MISSING_REQUIRED_VALUE", dotted(e.path))
            if node is None:
                cases.add(True, gone)
                return None
            if node.present is not None:
                cases.add(~node.present, gone)
            found = node.tag()
            bad = lambda got: self.error(e.path, F.concat(F.lit(f"expected {e.expected} at {dotted(e.path)}, got "), got), e.expected, got)
            if not node.variant and tag_of_type(node.kind) != e.expected and e.expected != NULL:
                cases.add(True, bad(found))
                return None
            cases.add(found != e.expected, bad(found))
            return node
        if isinstance(e, CollectionPredicate):
            if e.op != "COUNT":
                cases.add(True, self.error(location_of(e), f"{e.op} produces a Boolean and cannot be a numeric operand", "COUNT:Number", f"{e.op}:Boolean"))
                return None
            source = self.value(e.source, cases)
            if source is None:
                return None
            elements = self._elements(source, (), "count: source must be Sequence or Mapping, got ", cases)
            if elements is None:
                return None
            array, _, element = elements
            return Node(T.LongType(), F.size(F.filter(array, lambda x: matches(e.predicate, element(x)))).cast("long"))
        if isinstance(e, Not):
            cases.add(True, self.error(location_of(e), "boolean negation cannot be a numeric operand", "Number", "Not:Boolean"))
            return None
        raise Refusal("NOT_EVALUABLE", f"{type(e).__name__} can't be a value of a row")

    def _elements(self, node: Node, loc: Path, message: str, cases: _Cases):
        """(array, keys, element -> node) of a collection, or None if it can't be one."""
        bad = lambda got: self.error(loc, F.concat(F.lit(message), got), "Sequence|Mapping", got)
        if node.known:
            raise Refusal("NOT_EVALUABLE", "a literal is no collection of rows' values; write its size")
        found = node.tag()
        if node.variant:
            cases.add(~found.isin(SEQUENCE, MAPPING), bad(found))
            as_array, as_map = F.try_variant_get(node.column, "$", "array<variant>"), F.try_variant_get(node.column, "$", "map<string,variant>")
            array = F.when(found == SEQUENCE, as_array).otherwise(F.map_values(as_map))
            keys = F.when(found == SEQUENCE, F.transform(as_array, lambda _, i: i.cast("string"))).otherwise(F.map_keys(as_map))
            return array, keys, lambda x: Node(T.VariantType(), x)
        kind = node.kind
        if tag_of_type(kind) not in (SEQUENCE, MAPPING):
            cases.add(True, bad(found))
            return None
        cases.add(node.column.isNull(), bad(F.lit(NULL)))
        if isinstance(kind, T.ArrayType):
            return node.column, F.transform(node.column, lambda _, i: i.cast("string")), lambda x: Node(kind.elementType, x)
        if isinstance(kind, T.MapType):
            return F.map_values(node.column), F.map_keys(node.column), lambda x: Node(kind.valueType, x)
        same = {f.dataType.simpleString() for f in kind.fields}
        if len(same) != 1:
            raise Refusal("NOT_EVALUABLE", "a struct with fields of several types can't be a collection")
        return F.array(*[node.column.getField(n) for n in kind.names]), F.array(*[F.lit(n) for n in kind.names]), lambda x: Node(kind.fields[0].dataType, x)

    # booleans

    def boolean(self, e: Expression) -> Column:
        """The state of a boolean expression."""
        if isinstance(e, Literal):
            if isinstance(e.value, bool):
                return self.state("T" if e.value else "F")
            return self.error((), f"boolean expression cannot be coerced from {tag(e.value)}", "Boolean", tag(e.value))
        if isinstance(e, FieldRef):
            return self.error(e.path, "field reference is not a boolean expression on its own", "Boolean", "FieldRef")
        if isinstance(e, Not):
            body = self.boolean(e.body)
            if not self.diagnostics:
                return _mapped(body, {"T": "F", "F": "T", "MR": "MR", "MO": "MO", "CPF": "CPF", "ERR": "ERR"})
            return F.when(body["st"] == "T", self.state("F")).when(body["st"] == "F", self.state("T")).otherwise(body)
        if isinstance(e, Comparison):
            return self._comparison(e)
        if isinstance(e, CollectionPredicate):
            return self._collection(e)
        raise Refusal("NOT_EVALUABLE", f"{type(e).__name__} {getattr(e, 'name', '')} can't be evaluated row by row")

    def _comparison(self, e: Comparison) -> Column:
        cases = _Cases()
        left = self.value(e.left, cases)
        right = self.value(e.right, cases) if left is not None else None
        if left is None or right is None:
            return cases.otherwise(self.state("F"))
        kind, name, word = {"TEXT_EQUALS": (TEXT, "textEquals", "Text"), "BOOLEAN_EQUALS": (BOOLEAN, "booleanEquals", "Boolean")}.get(e.op, (NUMBER, "comparison", "Number"))
        for side, node, at in (("LHS", left, e.left), ("RHS", right, e.right)):
            wrong = lambda got: self.error(location_of(at), F.concat(F.lit(f"{name} {side} must be {word}, got "), got), word, got)  # noqa: B023, E731
            expected = at.expected if isinstance(at, FieldRef) else None  # already of this tag, or refused above
            if node.known or expected is not None:
                got = tag(node.literal) if node.known else expected
                cases.add(got != kind, wrong(F.lit(got)))
            elif not isinstance(at, CollectionPredicate):
                cases.add(node.tag() != kind, wrong(node.tag()))
            elif kind != NUMBER:
                cases.add(True, wrong(F.lit(NUMBER)))
        if cases.closed is not None:
            return cases.otherwise(self.state("F"))
        if kind == NUMBER:
            for node, at in ((left, e.left), (right, e.right)):
                unfit = self.error(location_of(at), "non-finite numeric values cannot be compared", "finite Number", number_text(node))
                if node.known:
                    cases.add(not node.literal.finite, unfit)
                elif isinstance(node.kind, T.FractionalType) and not isinstance(node.kind, T.DecimalType):
                    cases.add(F.isnan(node.column) | (F.abs(node.column) == float("inf")), unfit)
            if cases.closed is not None:
                return cases.otherwise(self.state("F"))
            holds = compare_numbers(left, e.op, right)
        else:
            holds = _scalar(left, kind) == _scalar(right, kind)
        return cases.otherwise(F.when(F.coalesce(holds, F.lit(False)), self.state("T")).otherwise(self.state("F")))

    def _collection(self, e: CollectionPredicate) -> Column:
        if e.op == "COUNT":
            return self.error(location_of(e), "COUNT produces a Number and must be used in a numeric comparison", "Boolean-valued collection predicate", "COUNT:Number")
        cases = _Cases()
        source = self.value(e.source, cases)
        found = self._elements(source, location_of(e.source), "CollectionPredicate source must be Sequence or Mapping, got ", cases) if source is not None else None
        if found is None:
            return cases.otherwise(self.state("F"))
        array, keys, element = found
        match = lambda x: matches(e.predicate, element(x))
        if e.op == "ALL":
            failing = F.filter(F.transform(array, lambda x, i: F.when(match(x), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
            key = F.get(keys, F.get(failing, F.lit(0)))
            prefix = dotted(location_of(e.source))
            failed = self.state("CPF", "COLLECTION_PREDICATE_FAILED", F.concat(F.lit(prefix + "." if prefix else ""), key), F.concat(F.lit("all: predicate failed at "), key))
            return cases.otherwise(F.when(F.forall(array, match), self.state("T")).otherwise(failed))
        holds = F.exists(array, match)
        return cases.otherwise(F.when(holds if e.op == "ANY" else ~holds, self.state("T")).otherwise(self.state("F")))

    # rules

    def actual(self, rule: Rule) -> Column:
        """What a violation of a false comparison says was found."""
        e = rule.expression
        if rule.actual is not None:
            return F.lit(rule.actual)
        if not isinstance(e, Comparison) or not isinstance(e.left, FieldRef):
            return F.lit(None).cast("string")
        node = self.root(e.left.path)
        if node is None or e.left.expected not in (TEXT, NUMBER, BOOLEAN) or (not node.variant and tag_of_type(node.kind) != e.left.expected):
            return F.lit(None).cast("string")
        text = number_text(node) if e.left.expected == NUMBER else _scalar(node, e.left.expected).cast("string")
        return F.when(node.has() & (node.tag() == e.left.expected), text)

    def outcome(self, r: Rule) -> Column:
        """The outcome of a rule alone."""
        slim = self if not self.diagnostics else Compiler(self.schema, self.document, False)
        main = _mapped(slim.boolean(r.expression), {"T": "PASSED", "F": "VIOLATED", "MR": "VIOLATED", "CPF": "VIOLATED", "MO": "NOT_APPLICABLE", "ERR": "ERROR"})
        if r.applies_when is None:
            return main
        gate = slim.boolean(r.applies_when)
        return F.when(gate == "T", main).otherwise(_mapped(gate, {"F": "NOT_APPLICABLE", "MR": "NOT_APPLICABLE", "MO": "NOT_APPLICABLE", "CPF": "ERROR", "ERR": "ERROR"}))

    def rule(self, r: Rule, body: Column | None = None, gate: Column | None = None) -> Column:
        """struct(outcome, code, location, message, expected, actual) of a rule: PASSED, VIOLATED, NOT_APPLICABLE or ERROR.

        `body` and `gate` are columns that hold the states of its expressions already, so that a plan has these once.
        """
        body = self.boolean(r.expression) if body is None else body
        result = lambda outcome, *v: F.struct(F.lit(outcome).alias("outcome"), *[(x if isinstance(x, Column) else F.lit(x).cast("string")).alias(n) for n, x in zip(("code", "location", "message", "expected", "actual"), v)])
        none = (None,) * 5
        error = lambda s: result("ERROR", s["code"], s["loc"], s["msg"], s["exp"], s["act"])
        main = (
            F.when(body["st"] == "T", result("PASSED", *none))
            .when(body["st"] == "F", result("VIOLATED", "COMPARISON_FAILED", dotted(location_of(r.expression)), r.message, expected_text(r), self.actual(r)))
            .when(body["st"] == "MO", result("NOT_APPLICABLE", *none))
            .when(body["st"].isin("MR", "CPF"), result("VIOLATED", body["code"], body["loc"], r.message, r.expected, r.actual))
            .otherwise(error(body))
        )
        if r.applies_when is None:
            return main
        gate = self.boolean(r.applies_when) if gate is None else gate
        return F.when(gate["st"] == "T", main).when(gate["st"].isin("F", "MR", "MO"), result("NOT_APPLICABLE", *none)).otherwise(error(gate))

    def matches_row(self, predicate: Selector) -> Column:
        """Whether the row itself matches, for aggregates over the data set."""
        if self.document is not None:
            return matches(predicate, Node(T.VariantType(), F.col(_quoted(self.document))))
        return matches_node(predicate, self.root(predicate.path))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal_node(value: object) -> Node:
    if isinstance(value, Num):
        column = F.lit(value.value if not isinstance(value.value, int) or -(1 << 63) <= value.value < 1 << 63 else Decimal(value.value))
        return Node(T.DoubleType() if isinstance(value.value, float) else T.LongType(), column, literal=value, known=True)
    return Node(_BOOL if isinstance(value, bool) else T.StringType(), F.lit(value) if isinstance(value, (str, bool)) else F.lit(None).cast("string"), literal=value, known=True)


def _scalar(node: Node, kind: str) -> Column:
    """A text or boolean as such; only where the tag is known to be right."""
    if node.variant:
        return F.try_variant_get(node.column, "$", "string" if kind == TEXT else "boolean")
    return node.column


def number_text(node: Node) -> Column:
    """A number as diagnostics write it."""
    if node.known:
        return F.lit(str(node.literal))
    return F.try_variant_get(node.column, "$", "string") if node.variant else node.column.cast("string")


def matches(predicate: Selector, element: Node) -> Column:
    """Whether an element of a collection matches; one that is no mapping stands under the key `value`."""
    if element.variant:
        inside = matches_node(predicate, descend(element, predicate.path))
        alone = matches_node(predicate, descend(element, predicate.path[1:]) if predicate.path[:1] == ("value",) else None)
        if not predicate.path:
            alone = F.lit(predicate.expected in (None, MAPPING))
        return F.when(element.tag() == MAPPING, inside).otherwise(alone)
    if tag_of_type(element.kind) == MAPPING:
        # a null element is no mapping
        alone = F.lit(predicate.optional) if predicate.path != ("value",) else F.lit(predicate.expected in (None, NULL))
        return F.when(element.column.isNull(), alone).otherwise(matches_node(predicate, descend(element, predicate.path)))
    if not predicate.path:
        return F.lit(predicate.expected in (None, MAPPING))
    return matches_node(predicate, descend(element, predicate.path[1:]) if predicate.path[0] == "value" else None)


def matches_node(predicate: Selector, node: Node | None) -> Column:
    if node is None:
        return F.lit(predicate.optional)
    right = F.lit(True) if predicate.expected is None else node.tag() == predicate.expected
    return right if node.present is None else F.when(node.present, right).otherwise(F.lit(predicate.optional))


_FLIP = {"GT": "LT", "LT": "GT", "GTE": "LTE", "LTE": "GTE", "EQ": "EQ", "NEQ": "NEQ"}


def _by(op: str, a: Column, b: Column) -> Column:
    return {"EQ": a == b, "NEQ": a != b, "GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op]


def compare_numbers(left: Node, op: str, right: Node) -> Column:
    """An exact comparison: a double counts as its binary value, and a literal between two values of a column's type is rounded to the side that keeps the answer."""
    if left.known and right.known:
        a, b = left.literal.exact(), right.literal.exact()
        return F.lit({"EQ": a == b, "NEQ": a != b, "GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op])
    if left.known:
        return compare_numbers(right, _FLIP[op], left)
    if right.known:
        return _against_literal(left, op, right.literal)
    if left.variant or right.variant:
        as_node = lambda n: (F.schema_of_variant(n.column).startswith("DOUBLE"), F.try_variant_get(n.column, "$", "double"), F.try_variant_get(n.column, "$", _WIDE.simpleString())) if n.variant else (F.lit(isinstance(n.kind, (T.DoubleType, T.FloatType))), n.column.cast("double"), n.column.cast(_WIDE))
        (da, fa, wa), (db, fb, wb) = as_node(left), as_node(right)
        return F.when(da | db | wa.isNull() | wb.isNull(), _by(op, fa, fb)).otherwise(_by(op, wa, wb))
    return _by(op, left.column, right.column)


def _against_literal(node: Node, op: str, literal: Num) -> Column:
    exact = literal.exact()
    if node.variant:
        double, wide = F.try_variant_get(node.column, "$", "double"), F.try_variant_get(node.column, "$", _WIDE.simpleString())
        fits = abs(exact) < 10**25 and Decimal(exact) == round(Decimal(exact), 12) if not isinstance(exact, int) else abs(exact) < 10**25
        as_double = _against_literal(Node(T.DoubleType(), double), op, literal)
        if not fits:
            return as_double
        return F.when(F.schema_of_variant(node.column).startswith("DOUBLE") | wide.isNull(), as_double).otherwise(_by(op, wide, F.lit(Decimal(exact)).cast(_WIDE)))
    if isinstance(node.kind, (T.DoubleType, T.FloatType)):
        column, near = node.column.cast("double"), float(exact)
        if near in (float("inf"), float("-inf")):
            return F.lit(op in (("NEQ", "LT", "LTE") if near > 0 else ("NEQ", "GT", "GTE")))
        if Decimal(near) == exact:
            return _by(op, column, F.lit(near))
        if op in ("EQ", "NEQ"):
            return F.lit(op == "NEQ")
        if Decimal(near) < exact:
            return column <= near if op in ("LT", "LTE") else column > near
        return column < near if op in ("LT", "LTE") else column >= near
    if isinstance(node.kind, T.IntegralType):
        whole = floor(exact)
        if whole != exact:
            if op in ("EQ", "NEQ"):
                return F.lit(op == "NEQ")
            op, exact = ("LTE" if op in ("LT", "LTE") else "GT"), whole
        exact = int(exact)
        if not -(1 << 63) <= exact < 1 << 63:
            return F.lit(op in (("NEQ", "LT", "LTE") if exact > 0 else ("NEQ", "GT", "GTE")))
        return _by(op, node.column, F.lit(exact).cast(node.kind) if -(1 << 31) <= exact < 1 << 31 and not isinstance(node.kind, (T.ByteType, T.ShortType)) else F.lit(exact))
    value = Decimal(exact)
    digits = value.as_tuple()
    if max(len(digits.digits), -digits.exponent) <= 38:
        return _by(op, node.column, F.lit(value))
    low = value.quantize(Decimal(1).scaleb(-node.kind.scale), rounding="ROUND_FLOOR")  # no value of the column lies between
    if op in ("EQ", "NEQ"):
        return F.lit(op == "NEQ")
    return node.column <= F.lit(low) if op in ("LT", "LTE") else node.column > F.lit(low)
