"""Declared rules: predicates, cardinality rules, satisfiability, the constraint language, expressions, linear systems."""

from __future__ import annotations

import ast
import itertools
import math
import re
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DEC, decimal, exact, exact_root, minus, number_text, over, plus, power, project, times, total


# Predicates and rules over them: null is unknown, and only false is a violation.


def present(c: str) -> Column:
    return F.col(c).isNotNull()


def equals(c: str, value) -> Column:
    return F.col(c) == F.lit(value)


def truthy(c: str, kind: str) -> Column:
    v = F.col(c)
    if kind == "boolean":
        return v
    return v != 0 if kind == "number" else v != ""


def implies(antecedents: list[Column], consequent: Column) -> Column:
    return ~reduce(lambda a, b: a & b, antecedents, F.lit(True)) | consequent


def cardinality(predicates: list[Column], least: int = 0, most: int | None = None) -> Column:
    total = reduce(lambda a, b: a + b, (p.cast("int") for p in predicates))
    ok = total >= least
    return ok if most is None else ok & (total <= most)


def exactly_one(*p: Column) -> Column:
    return cardinality(list(p), 1, 1)


def any_of(*p: Column) -> Column:
    return cardinality(list(p), 1)


def not_both(*p: Column) -> Column:
    return cardinality(list(p), 0, 1)


def satisfiable(clauses: list[list[int]], fixed: dict[int, bool] | None = None) -> dict[int, bool] | None:
    """An assignment that satisfies all clauses of signed variables (DPLL, unit propagation, false first), or None."""
    values = dict(fixed or {})
    while True:
        unit = None
        for clause in clauses:
            if any(values.get(abs(x)) == (x > 0) for x in clause):
                continue
            free = [x for x in clause if abs(x) not in values]
            if not free:
                return None
            if len(free) == 1:
                unit = free[0]
                break
        if unit is None:
            break
        values[abs(unit)] = unit > 0
    free = sorted({abs(x) for c in clauses for x in c} - set(values))
    if not free:
        return values
    for choice in (False, True):
        found = satisfiable(clauses, values | {free[0]: choice})
        if found is not None:
            return found
    return None


def unsatisfiable_core(clauses: list[list[int]]) -> list[int]:
    """Indexes of clauses that can't be satisfied together and all of which are needed for that; empty if they can."""
    if satisfiable(clauses) is not None:
        return []
    kept = list(range(len(clauses)))
    for i in list(kept):
        rest = [j for j in kept if j != i]
        if satisfiable([clauses[j] for j in rest]) is None:
            kept = rest
    return kept


#: Declared rule kinds, and most rules of one file.
RULE_KINDS = ("implies", "exactly_one", "xor", "one_of", "any_of", "not_both")
MOST_RULES = 256


@dataclass(frozen=True)
class Atom:
    """A predicate on a field: present, truthy, or equal to a value."""

    field: str
    test: str = "truthy"
    value: object = None

    def column(self) -> Column:
        c = F.col(self.field)
        if self.test == "present":
            return c.isNotNull()
        return c.eqNullSafe(F.lit(self.value)) if self.test == "equals" else c


def atom_of(text) -> Atom:
    """A field name, or {field, equals: v} or {field, present: true}."""
    if isinstance(text, str):
        return Atom(text)
    if "equals" in text:
        return Atom(text["field"], "equals", text["equals"])
    return Atom(text["field"], "present" if text.get("present") else "truthy")


def load_rules(text: str) -> list[dict]:
    """Rules of a JSON file: a list of objects with an id, a kind of RULE_KINDS, atoms in ``of``, and for implications ``then``.
    An unknown kind, a repeated id, or more than MOST_RULES are refused."""
    from ..sources.syntax import parse_strict

    rules = parse_strict(text)
    if not isinstance(rules, list) or len(rules) > MOST_RULES:
        raise ValueError(f"a list of at most {MOST_RULES} rules")
    if len({r.get("id") for r in rules}) < len(rules):
        raise ValueError("rule ids must differ")
    for r in rules:
        if r.get("kind") not in RULE_KINDS or not isinstance(r.get("of"), list) or (r["kind"] == "implies") != ("then" in r):
            raise ValueError(f"not a rule: {r}")
    return rules


def rule_column(rule: dict) -> Column:
    """Whether a row keeps a rule; null if a predicate is unknown."""
    of = [atom_of(a).column() for a in rule["of"]]
    if rule["kind"] == "implies":
        return implies(of, atom_of(rule["then"]).column())
    return any_of(*of) if rule["kind"] == "any_of" else not_both(*of) if rule["kind"] == "not_both" else exactly_one(*of)


def compile_clauses(rules: list[dict]) -> tuple[list[list[int]], list[str | None], list[Atom]]:
    """(clauses, the rule that each comes from, atoms by number from 1).  Beside the rules' own there are clauses that any two
    different values of one field exclude each other, and that a field which equals a value is present."""
    atoms: dict[Atom, int] = {}
    number = lambda a: atoms.setdefault(a, len(atoms) + 1)
    clauses: list[list[int]] = []
    origin: list[str | None] = []
    for r in rules:
        of = [number(atom_of(a)) for a in r["of"]]
        if r["kind"] == "implies":
            own = [[*(-x for x in of), number(atom_of(r["then"]))]]
        else:
            own = [] if r["kind"] == "not_both" else [list(of)]
            if r["kind"] != "any_of":
                own += [[-a, -b] for a, b in itertools.combinations(of, 2)]
        clauses += own
        origin += [r["id"]] * len(own)
    for a, b in itertools.combinations(list(atoms), 2):
        if a.field == b.field and a.test == b.test == "equals" and a.value != b.value:
            clauses.append([-atoms[a], -atoms[b]])
            origin.append(None)
        for x, y in ((a, b), (b, a)):
            if x.field == y.field and x.test == "equals" and y.test == "present":
                clauses.append([-atoms[x], atoms[y]])
                origin.append(None)
    return clauses, origin, list(atoms)


def conflicting_rules(rules: list[dict]) -> list[str]:
    """Ids of rules that can't all be kept, and all of which are needed for that; none if they can."""
    if satisfiable(compile_clauses(rules)[0]) is not None:
        return []
    kept = list(rules)
    for r in list(rules):
        rest = [x for x in kept if x is not r]
        if satisfiable(compile_clauses(rest)[0]) is None:
            kept = rest
    return [r["id"] for r in kept]


def authoritative(df: DataFrame, key: str, rules: list[dict]) -> DataFrame:
    """(row_id, rule_id, code): rows that break declared rules.  Rules that can't all be kept are reported instead, once
    (row_id null), and judge no row."""
    core = conflicting_rules(rules)
    if core:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([(None, i, "logical_rule_system_unsat") for i in core], f"row_id {kind}, rule_id string, code string")
    broken = F.array(*(F.when(~rule_column(r), F.lit(r["id"])) for r in rules))
    return df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(broken)).alias("rule_id")).withColumn("code", F.lit("logical_constraint_violation"))


def infer_exactly_one(df: DataFrame, fields: list[str], confidence: float = 0.95) -> DataFrame:
    """(fields, support, decided): sets of two to four boolean fields of which nearly always exactly one is true."""
    sets = [s for k in (2, 3, 4) for s in itertools.combinations(sorted(fields), k)]
    aggs, items = [], []
    for i, s in enumerate(sets):
        total = reduce(lambda a, b: a + b, (F.col(c).cast("int") for c in s))
        aggs += [F.count(F.when(total == 1, 1)).alias(f"s{i}"), F.count(total).alias(f"d{i}")]
        items.append(F.struct(F.lit(",".join(s)).alias("fields"), F.col(f"s{i}").alias("support"), F.col(f"d{i}").alias("decided")))
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("f")).select("f.*").where(f"decided >= 4 and support / decided >= {confidence}")


def infer_implies(df: DataFrame, fields: list[str], confidence: float = 0.95) -> DataFrame:
    """(a, b, target, value, support, decided): a and b imply a value of the target, which must vary overall."""
    sets = [(a, b, t) for a, b in itertools.combinations(sorted(fields), 2) for t in sorted(fields) if t not in (a, b)]
    aggs, items = [], []
    for i, (a, b, t) in enumerate(sets):
        both = F.col(a) & F.col(b)
        aggs += [F.count(F.when(both & F.col(t), 1)).alias(f"t{i}"), F.count(F.when(both, F.col(t))).alias(f"d{i}"), (F.max(F.col(t).cast("int")) != F.min(F.col(t).cast("int"))).alias(f"v{i}")]
        yes = F.col(f"t{i}") * 2 >= F.col(f"d{i}")
        items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("target"), yes.alias("value"), F.when(yes, F.col(f"t{i}")).otherwise(F.col(f"d{i}") - F.col(f"t{i}")).alias("support"), F.col(f"d{i}").alias("decided"), F.col(f"v{i}").alias("varies")))
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("f")).select("f.*").where(f"varies and decided >= 4 and support / decided >= {confidence}").drop("varies")


# The constraint language: one rule a line, ``field keyword argument``.


@dataclass
class Rule:
    field: str
    kind: str
    argument: object = None


@dataclass
class Rules:
    scope: str = ""
    simple: list[Rule] = field(default_factory=list)
    expressions: list[tuple[str, str]] = field(default_factory=list)
    linear: list[tuple[dict[str, Fraction], Fraction]] = field(default_factory=list)


def parse_rules(text: str) -> Rules:
    """Lines: ``scope /path/of/rows``, ``expr left = right``, ``linear 2 a + b - c = 0``, or ``field kind [argument]``; # starts a comment."""
    import json

    out = Rules()
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).strip()
        if not line:
            continue
        head, _, rest = line.partition(" ")
        if head == "scope":
            out.scope = rest.strip()
        elif head == "expr":
            left, sign, right = rest.partition("=")
            if not sign:
                raise ValueError(f"no equals sign: {line}")
            out.expressions.append((left.strip(), right.strip()))
        elif head == "linear":
            left, _, right = rest.partition("=")
            terms: dict[str, Fraction] = {}
            sign = 1
            number = Fraction(1)
            for token in left.replace("+", " + ").replace("-", " - ").replace("*", " ").split():
                if token in "+-":
                    sign, number = (1 if token == "+" else -1), Fraction(1)
                elif token[0].isdigit():
                    number = Fraction(token)
                else:
                    terms[token] = terms.get(token, Fraction(0)) + sign * number
                    sign, number = 1, Fraction(1)
            out.linear.append((terms, Fraction(right.strip())))
        else:
            kind, _, argument = rest.partition(" ")
            if kind not in CHECKS:
                raise ValueError(f"unknown rule: {line}")
            out.simple.append(Rule(head, kind, json.loads(argument) if argument.strip() else None))
    return out


_NUMERIC = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
CHECKS = {
    "require": lambda c, a: c.isNotNull(),
    "type": lambda c, a: {"integer": c.try_cast("bigint").isNotNull(), "number": c.try_cast("double").isNotNull(), "boolean": c.try_cast("boolean").isNotNull(), "string": c.isNotNull()}[a],
    "enum": lambda c, a: c.isin(a),
    "const": lambda c, a: c.eqNullSafe(F.lit(a)),
    "minimum": lambda c, a: exact(c) >= decimal(a),
    "maximum": lambda c, a: exact(c) <= decimal(a),
    "exclusiveMinimum": lambda c, a: exact(c) > decimal(a),
    "exclusiveMaximum": lambda c, a: exact(c) < decimal(a),
    "multipleOf": lambda c, a: F.pmod(exact(c), decimal(a)) == 0,
    "minLength": lambda c, a: F.char_length(c) >= a,
    "maxLength": lambda c, a: F.char_length(c) <= a,
    "minItems": lambda c, a: F.size(c) >= a,
    "maxItems": lambda c, a: F.size(c) <= a,
    "minProperties": lambda c, a: F.size(F.json_object_keys(c)) >= a,
    "maxProperties": lambda c, a: F.size(F.json_object_keys(c)) <= a,
    "uniqueItems": lambda c, a: F.size(F.array_distinct(c)) == F.size(c),
    "pattern": lambda c, a: c.rlike(a),
}


def evaluate(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(row_id, field, code, old_value, new_value) of violated rules: one pass, a row for each violation.

    const and a required default give their value, an enumeration its only member that differs by case, numeric bounds the
    nearest number that satisfies all bounds of the field."""
    items = []
    for r in rules:
        c = F.col(r.field)
        ok = CHECKS[r.kind](c, r.argument)
        new = F.lit(None).cast("string")
        if r.kind == "const" or r.kind == "require" and r.argument is not None:
            new = F.lit(str(r.argument))
        elif r.kind == "enum":
            folded = [x for x in r.argument if sum(y.lower() == x.lower() for y in r.argument) == 1]
            new = F.coalesce(*(F.when(F.lower(c) == x.lower(), F.lit(x)) for x in folded), F.lit(None).cast("string"))
        elif r.kind in _NUMERIC:
            own = {x.kind: x.argument for x in rules if x.field == r.field and x.kind in _NUMERIC}
            if "exclusiveMinimum" not in own and "exclusiveMaximum" not in own:
                new = number_text(project(c, own.get("minimum"), own.get("maximum"), own.get("multipleOf")))
        code = "required_missing" if r.kind == "require" else f"{r.kind}_violation"
        items.append(F.when(~ok, F.struct(F.lit(r.field).alias("field"), F.lit(code).alias("code"), c.cast("string").alias("old_value"), new.alias("new_value"))))
    return df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*items))).alias("i")).select("row_id", "i.*")


# Expressions: a small whitelisted language compiled to exact columns.

def _known(function):
    """Null if an argument is: greatest and least would skip it."""
    return lambda *x: F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in x)), function(*x))


_CALLS = {
    "abs": F.abs, "floor": lambda x: F.floor(x).cast(DEC), "ceil": lambda x: F.ceil(x).cast(DEC), "min": _known(lambda *x: F.least(*x) if x[1:] else x[0]), "max": _known(lambda *x: F.greatest(*x) if x[1:] else x[0]),
    "sum": lambda *x: total(*x), "product": lambda *x: reduce(times, x), "mod": lambda a, b: F.pmod(a, F.nullif(b, F.lit(0).cast(DEC))).cast(DEC), "sqrt": lambda x: exact_root(x, 2),
}
#: Largest whole power that an expression may have.
MOST_POWER = 64


def compile_expression(text: str) -> Column:
    """Exact column of an expression: + - * / % **, whole powers and 1/n-th roots, and the calls in _CALLS.  Null where a
    field is, where it isn't defined, and where the value has more digits than DEC."""

    def walk(node) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return decimal(str(node.value))
        if isinstance(node, ast.Name):
            return exact(node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return F.negative(walk(node.operand))
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if type(node.op) in _OPERATORS:
                return _OPERATORS[type(node.op)](a, b)
            exponent = _whole(node.right)
            if isinstance(node.op, ast.Pow) and exponent is not None and abs(exponent) <= MOST_POWER:
                return power(a, exponent)
            if isinstance(node.op, ast.Pow) and (root := _root(node.right)):
                return exact_root(a, root)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return _CALLS[node.func.id](*map(walk, node.args))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:60]}")

    return walk(ast.parse(text.strip(), mode="eval"))


_OPERATORS = {ast.Add: plus, ast.Sub: minus, ast.Mult: times, ast.Div: over, ast.Mod: _CALLS["mod"]}


def _whole(node) -> int | None:
    sign = 1
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        node, sign = node.operand, -1
    return sign * node.value if isinstance(node, ast.Constant) and isinstance(node.value, int) and not isinstance(node.value, bool) else None


def _root(node) -> int | None:
    """n of an exponent 1/n."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Div) and _whole(node.left) == 1:
        n = _whole(node.right)
        return n if n and 0 < n <= MOST_POWER else None
    return None


def expression_fields(text: str) -> list[str]:
    """The fields that an expression reads."""
    return sorted({n.id for n in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(n, ast.Name)} - set(_CALLS))


def expression_status(text: str) -> Column:
    """VALUE, UNKNOWN if a field is missing or no number, DOMAIN_ERROR if the expression isn't defined (a division by zero,
    a root that isn't exact) or its value has more digits than DEC."""
    known = reduce(lambda a, b: a & b, (exact(f).isNotNull() for f in expression_fields(text)), F.lit(True))
    return F.when(~known, "UNKNOWN").when(compile_expression(text).isNotNull(), "VALUE").otherwise("DOMAIN_ERROR")


def solve_for(text: str, name: str, value: str) -> str | None:
    """The expression for ``name`` with text = value, if it stands in it once behind invertible operations only."""

    def count(node) -> int:
        return sum(isinstance(n, ast.Name) and n.id == name for n in ast.walk(node))

    node, out = ast.parse(text.strip(), mode="eval").body, f"({value})"
    if count(node) != 1:
        return None
    while not (isinstance(node, ast.Name) and node.id == name):
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            node, out = node.operand, f"(-{out})"
            continue
        if not isinstance(node, ast.BinOp):
            return None
        left = count(node.left) == 1
        other = f"({ast.unparse(node.right if left else node.left)})"
        if isinstance(node.op, ast.Add):
            out = f"({out} - {other})"
        elif isinstance(node.op, ast.Sub):
            out = f"({out} + {other})" if left else f"({other} - {out})"
        elif isinstance(node.op, ast.Mult):
            out = f"({out} / {other})"
        elif isinstance(node.op, ast.Div):
            out = f"({out} * {other})" if left else f"({other} / {out})"
        else:
            return None
        node = node.left if left else node.right
    return out


def expression_rule(df: DataFrame, key: str, left: str, right: str, target: str | None = None) -> DataFrame:
    """Rows where left = right doesn't hold, with the value of the target that makes it hold.  The target is named, or a bare
    field on the left; a value is given only if the equation then holds exactly."""
    a, b = compile_expression(left), compile_expression(right)
    target = target or (left.strip() if left.strip().isidentifier() else None)
    inverse = None
    if target:
        inverse = right if left.strip() == target else solve_for(left, target, right) or solve_for(right, target, left)
    new = compile_expression(inverse) if inverse else F.lit(None).cast(DEC)
    rows = df.withColumns({"_l": a, "_r": b, "_n": new})
    code = F.when(F.col("_l") != F.col("_r"), "expression_violation").otherwise("expression_unknown")
    out = rows.where((F.col("_l") != F.col("_r")) | (F.col("_l").isNull() | F.col("_r").isNull()))
    if inverse:
        check = out.withColumn(target, F.col("_n")).withColumns({"_l2": a, "_r2": b})
        return check.select(F.col(key).alias("row_id"), code.alias("code"), F.when(F.col("_l2") == F.col("_r2"), F.col("_n")).alias("new_value"))
    return out.select(F.col(key).alias("row_id"), code.alias("code"), F.col("_n").alias("new_value"))


def linear_system(df: DataFrame, key: str, equations: list[tuple[dict[str, Fraction], Fraction]]) -> DataFrame:
    """Rows that violate an equation, with the one field whose single change closes all of them, if there is one."""
    fields = sorted({f for terms, _ in equations for f in terms})
    # Times the common denominator, so that all coefficients are whole.
    whole = []
    for terms, right in equations:
        by = math.lcm(right.denominator, *(c.denominator for c in terms.values()))
        whole.append(({f: int(c * by) for f, c in terms.items() if c}, int(right * by)))
    residual = [minus(total(F.lit(0).cast(DEC), *(times(exact(f), decimal(c)) for f, c in sorted(terms.items()))), decimal(right)) for terms, right in whole]
    rows = df.withColumns({f"_e{i}": r for i, r in enumerate(residual)})
    broken = reduce(lambda a, b: a | b, (F.col(f"_e{i}") != 0 for i in range(len(whole))))
    options = []
    for f in fields:
        shift = next(over(F.negative(F.col(f"_e{i}")), decimal(t[f])) for i, (t, _) in enumerate(whole) if f in t)
        closes = reduce(lambda a, b: a & b, (plus(F.col(f"_e{i}"), times(shift, decimal(t.get(f, 0)))) == 0 for i, (t, _) in enumerate(whole)))
        options.append(F.when(closes, F.struct(F.lit(f).alias("field"), plus(exact(f), shift).alias("new_value"))))
    out = rows.where(broken).withColumn("_o", F.array_compact(F.array(*options)))
    one = F.when(F.size("_o") == 1, F.get("_o", F.lit(0)))
    return out.select(F.col(key).alias("row_id"), F.lit("linear_system_violation").alias("code"), one["field"].alias("field"), one["new_value"].alias("new_value"))
