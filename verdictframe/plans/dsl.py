"""Builders for rules; what they build is data, never a function."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from verdictframe.plans.ir import (
    BOOLEAN, NUMBER, TEXT, CollectionPredicate, Comparison, DatasetRef, Expression, FieldRef, Literal, Not, Num, Policy, PolicySet, Reference, Refusal, Rule, Selector, negate, number, substitute,
)


@dataclass(frozen=True)
class Field:
    """A place in a row or document; optional once an optional step was taken."""

    path: tuple[str, ...]
    optional: bool = False

    def field(self, name: str) -> Field:
        return Field((*self.path, name), self.optional)

    def optional_field(self, name: str) -> Field:
        return Field((*self.path, name), True)

    def typed(self, tag: str) -> Operand:
        return Operand(FieldRef(self.path, tag, self.optional))

    def number(self) -> Operand:
        return self.typed(NUMBER)

    def text(self) -> Operand:
        return self.typed(TEXT)

    def boolean(self) -> Operand:
        return self.typed(BOOLEAN)


def root(name: str) -> Field:
    return Field((name,))


def optional_root(name: str) -> Field:
    return Field((name,), True)


def _operand(x: object) -> Expression:
    if isinstance(x, Operand):
        return x.expression
    if isinstance(x, Expression):
        return x
    return Literal(number(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x)


@dataclass(frozen=True)
class Operand:
    """A value expression and the comparisons on it."""

    expression: Expression

    def _with(self, op: str, other: object) -> Comparison:
        return Comparison(self.expression, op, _operand(other))

    def eq(self, other: object) -> Comparison:
        return self._with("EQ", other)

    def neq(self, other: object) -> Comparison:
        return self._with("NEQ", other)

    def gt(self, other: object) -> Comparison:
        return self._with("GT", other)

    def gte(self, other: object) -> Comparison:
        return self._with("GTE", other)

    def lt(self, other: object) -> Comparison:
        return self._with("LT", other)

    def lte(self, other: object) -> Comparison:
        return self._with("LTE", other)

    def eq_text(self, other: object) -> Comparison:
        return self._with("TEXT_EQUALS", other)

    def eq_bool(self, other: object) -> Comparison:
        return self._with("BOOLEAN_EQUALS", other)


def num(x: int | float | Decimal | Num) -> Operand:
    return Operand(Literal(x if isinstance(x, Num) else number(x)))


def ref(name: str) -> Operand:
    return Operand(Reference(name))


def dataset(name: str) -> DatasetRef:
    return DatasetRef(name)


def select(*path: str, expected: str | None = None, optional: bool = False) -> Selector:
    return Selector(tuple(path), expected, optional)


def all_of(source: Expression, predicate: Selector) -> CollectionPredicate:
    return CollectionPredicate("ALL", source, predicate)


def any_of(source: Expression, predicate: Selector) -> CollectionPredicate:
    return CollectionPredicate("ANY", source, predicate)


def none_of(source: Expression, predicate: Selector) -> CollectionPredicate:
    return CollectionPredicate("NONE", source, predicate)


def count_of(source: Expression, predicate: Selector) -> Operand:
    return Operand(CollectionPredicate("COUNT", source, predicate))


def not_(e: Expression) -> Not:
    return Not(e)


def rule(
    id: str, *, require: Expression | None = None, forbid: Expression | None = None, applies_when: Expression | None = None, params: dict[str, object] | None = None,
    message: str | None = None, code: str | None = None, expected: str | None = None, actual: str | None = None, severity: str | None = None, supersession=None,
) -> Rule:
    """A rule that requires or forbids an expression, with its parameters put in."""
    if (require is None) == (forbid is None):
        raise Refusal("MALFORMED_RULE", f"rule {id} needs either require or forbid")
    values = {k: number(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v for k, v in (params or {}).items()}
    body = substitute(require if require is not None else forbid, values)
    gate = None if applies_when is None else substitute(applies_when, values)
    return Rule(id, message if message is not None else id, negate(body) if forbid is not None else body, gate, code, expected, actual, values, supersession, severity)


def policy(id: str, *rules: Rule) -> Policy:
    return Policy(id, tuple(rules))


def policy_set(id: str, *members: Policy | Rule) -> PolicySet:
    """A set of policies; a rule on its own becomes the policy `_anon-<id>`."""
    return PolicySet(id, tuple(m if isinstance(m, Policy) else Policy(f"_anon-{m.id}", (m,)) for m in members))


def with_severity(r: Rule, severity: str) -> Rule:
    return replace(r, severity=severity)
