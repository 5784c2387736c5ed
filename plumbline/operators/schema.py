"""JSON Schema compiled to columns.

Values are variants, so one compiled condition covers every type; a keyword that doesn't concern a value's type holds.  A
document is parsed once.  What the schema names by properties becomes columns of their own, stage after stage, so no
condition parses or searches the document again; only what hangs on positions or unknown keys is compiled to lambdas over
arrays and maps.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, reduce
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DEC, decimal, escape, exact, fold, number_text, project

MAX_DEPTH = 64
#: Longest pattern, and longest text that is matched with one.
MAX_PATTERN, MAX_MATCHED = 512, 65536
NUMBER = "decimal(38,18)"
_ISSUE = "array<struct<path:string,code:string,severity:string,old_value:string,new_value:string>>"


def _and(parts) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _or(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _kind(v: Column) -> Column:
    """JSON type name of a variant; null where there is none."""
    name = F.schema_of_variant(v)
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
    )


class Plan:
    """Columns that are computed once and then used by name; each stage is a selection on top of the one before."""

    def __init__(self) -> None:
        self.stages: list[dict[str, Column]] = []

    def put(self, stage: int, c: Column) -> Column:
        while len(self.stages) <= stage:
            self.stages.append({})
        name = f"_s{stage}_{len(self.stages[stage])}"
        self.stages[stage][name] = c
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for columns in self.stages:
            df = df.withColumns(columns)
        return df


class Value:
    """A variant and what conditions ask of it.  With a plan each answer is a column of the stage behind its value's."""

    def __init__(self, v: Column, plan: Plan | None = None, stage: int = 0):
        self.plan, self.stage, self.v = plan, stage, v
        self.known: dict[str, Value] = {}

    def _keep(self, c: Column, after: int) -> Column:
        return self.plan.put(self.stage + after, c) if self.plan else c

    @cached_property
    def kind(self) -> Column:
        return self._keep(_kind(self.v), 1)

    @cached_property
    def number(self) -> Column:
        return self._keep(F.when(self.kind.isin("integer", "number"), F.try_variant_get(self.v, "$", NUMBER)), 2)

    @cached_property
    def double(self) -> Column:
        return F.when(self.kind.isin("integer", "number"), F.try_variant_get(self.v, "$", "double"))

    @cached_property
    def text(self) -> Column:
        return self._keep(F.when(self.kind == "string", F.try_variant_get(self.v, "$", "string")), 2)

    @cached_property
    def items(self) -> Column:
        return self._keep(F.when(self.kind == "array", F.try_variant_get(self.v, "$", "array<variant>")), 2)

    @cached_property
    def members(self) -> Column:
        return self._keep(F.when(self.kind == "object", F.map_entries(F.try_variant_get(self.v, "$", "map<string,variant>"))), 2)

    @cached_property
    def json(self) -> Column:
        return F.to_json(self.v)

    def member(self, key: str) -> Value:
        if key not in self.known:
            quote = next((q for q in "'\"" if q not in key), None)
            if quote and "\\" not in key:
                own = F.try_variant_get(self.v, f"$[{quote}{key}{quote}]", "variant")
                found = F.when(self.kind == "object", own)
            else:
                found = F.get(F.filter(self.members, lambda e: e["key"] == key), F.lit(0))["value"]
            self.known[key] = Value(self._keep(found, 3), self.plan, self.stage + 3)
        return self.known[key]

    def has(self, key: str) -> Column:
        return self.member(key).v.isNotNull()


def resolve(reference: str, root):
    """What a local reference names; None if nothing."""
    at = root
    if not reference.startswith("#/"):
        return None
    for token in reference[2:].split("/"):
        token = token.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(token)] if isinstance(at, list) else at[token]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return at


def _referred(s: dict, root, stack: tuple[str, ...]):
    """(schema, problem): the reference's target with the keywords beside the reference on top of its own."""
    reference = s["$ref"]
    if reference in stack:
        return None, "schema_ref_cycle"
    target = resolve(reference, root)
    if target is None:
        return None, "schema_ref_unresolved"
    if isinstance(target, dict):
        target = {**target, **{k: v for k, v in s.items() if k != "$ref"}}
    return target, None


def safe_pattern(pattern) -> bool:
    """Whether a pattern can be matched without going back without bound: valid, not too long, and without a repeated group
    that itself has a repetition."""
    if not isinstance(pattern, str) or len(pattern) > MAX_PATTERN or re.search(r"\([^)]*[+*][^)]*\)[+*{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _finite(x) -> Fraction | None:
    if isinstance(x, bool) or not isinstance(x, int | float):
        return None
    try:
        return Fraction(str(x))
    except ValueError:
        return None


def _literal(x) -> Column:
    """Canonical JSON of a constant: equal values have equal texts, 1 and 1.0 too."""
    return F.to_json(F.parse_json(F.lit(json.dumps(x))))


_BOUNDS = {"minimum": lambda a, b: a >= b, "exclusiveMinimum": lambda a, b: a > b, "maximum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a < b}
_CODES = {"minimum": "minimum", "exclusiveMinimum": "exclusive_minimum", "maximum": "maximum", "exclusiveMaximum": "exclusive_maximum", "multipleOf": "multiple_of"}


def _numeric(s: dict, number: Column, double: Column) -> list[tuple[str, Column]]:
    """(keyword, condition) of the numeric keywords: numbers of 18 places and 20 digits before the point are compared
    exactly, others as doubles."""
    out = []
    for keyword, op in (*_BOUNDS.items(), ("multipleOf", lambda a, b: F.pmod(a, b) == 0)):
        bound = _finite(s.get(keyword))
        if bound is None or keyword == "multipleOf" and bound <= 0:
            continue
        scaled = bound * 10**18
        if scaled.denominator == 1 and abs(scaled.numerator) < 10**38:
            whole, part = divmod(abs(scaled.numerator), 10**18)
            literal = F.lit(f"{'-' if bound < 0 else ''}{whole}.{part:018d}").cast(NUMBER)
            out.append((keyword, F.coalesce(op(number, literal), op(double, F.lit(float(bound))), F.lit(True))))
        else:
            out.append((keyword, F.coalesce(op(double, F.lit(float(bound))), F.lit(True))))
    return out


def _projected(s: dict, value: Value) -> Column:
    """JSON text of the nearest number that all numeric keywords admit; null if there is none, or two."""
    low, high, step = _finite(s.get("minimum")), _finite(s.get("maximum")), _finite(s.get("multipleOf"))
    above, below = _finite(s.get("exclusiveMinimum")), _finite(s.get("exclusiveMaximum"))
    if s.get("type") == "integer":
        step = Fraction(1) if step is None else Fraction(step.numerator)
    if step is not None and step > 0:  # on a lattice an excluded bound has a nearest point beside it
        if above is not None:
            low = max(x for x in (low, (above // step + 1) * step) if x is not None)
        if below is not None:
            high = min(x for x in (high, -(-below // step) * step - step) if x is not None)
    if "const" in s or "enum" in s or step is not None and step <= 0:
        return F.lit(None).cast("string")
    try:
        near = project(F.to_json(value.v), low, high, step)
    except ValueError:  # a bound that has no exact decimal
        return F.lit(None).cast("string")
    ok = _and(c for _, c in _numeric(s, near.cast(NUMBER), near.cast("double")))
    return F.when(value.kind.isin("integer", "number") & near.isNotNull() & ok, number_text(near))


def _type_ok(value: Value, wanted) -> Column:
    wanted = wanted if isinstance(wanted, list) else [wanted]
    ok = value.kind.isin(wanted)
    if "number" in wanted:
        ok = ok | (value.kind == "integer")
    if "integer" in wanted:
        ok = ok | ((value.kind == "number") & F.coalesce(value.number == F.floor(value.number), value.double == F.floor(value.double)))
    return F.coalesce(ok, F.lit(False))


def _local(value: Value, s: dict, root, depth: int, stack: tuple[str, ...]) -> list[tuple[str, str, Column, Column | None]]:
    """(code, severity, condition, repaired JSON text) of the keywords that look at the value as a whole."""
    out: list[tuple[str, str, Column, Column | None]] = []
    holds = lambda c: F.coalesce(c, F.lit(True))
    sub = lambda x, t: valid(x, t, root, depth + 1, stack)

    def add(name: str, ok: Column, new: Column | None = None, severity: str = "warning") -> None:
        out.append((f"schema_{name}", severity, ok, new))

    if "const" in s:
        add("const_violation", value.json == _literal(s["const"]), F.lit(json.dumps(s["const"])))
    if isinstance(s.get("enum"), list):
        texts = [x for x in s["enum"] if isinstance(x, str)]
        alone = [x for x in texts if sum(y.casefold() == x.casefold() for y in texts) == 1]
        new = reduce(lambda a, x: F.when(fold(value.text) == fold(F.lit(x)), F.lit(json.dumps(x, ensure_ascii=False))).otherwise(a), alone, F.lit(None).cast("string"))
        add("enum_violation", _or(value.json == _literal(x) for x in s["enum"]), new)
    numeric = _numeric(s, value.number, value.double)
    nearest = _projected(s, value) if numeric else None
    for keyword, ok in numeric:
        add(f"{_CODES[keyword]}_violation", ok, nearest)
    is_number = value.kind.isin("integer", "number")
    for keyword in (*_BOUNDS, "multipleOf"):
        bound = _finite(s.get(keyword))
        if keyword in s and (bound is None or keyword == "multipleOf" and bound <= 0):
            add("invalid_multiple_of" if keyword == "multipleOf" else "invalid_boundary", holds(~is_number), severity="error")
    size = lambda c: F.when(c.isNotNull(), F.size(c))
    for keyword, name, got, op in (
        ("minLength", "min_length", lambda: F.char_length(value.text), "ge"), ("maxLength", "max_length", lambda: F.char_length(value.text), "le"),
        ("minItems", "min_items", lambda: size(value.items), "ge"), ("maxItems", "max_items", lambda: size(value.items), "le"),
        ("minProperties", "min_properties", lambda: size(value.members), "ge"), ("maxProperties", "max_properties", lambda: size(value.members), "le"),
    ):
        if isinstance(s.get(keyword), int):
            add(f"{name}_violation", holds(got() >= s[keyword] if op == "ge" else got() <= s[keyword]))
    if isinstance(s.get("pattern"), str):
        short = F.char_length(value.text) <= MAX_MATCHED
        if safe_pattern(s["pattern"]):
            add("pattern_unsupported", holds(short), severity="error")
            add("pattern_violation", holds(F.when(short, value.text.rlike(s["pattern"]))))
        else:
            add("pattern_unsupported", value.text.isNull(), severity="error")
    if s.get("uniqueItems") is True:
        texts = F.transform(value.items, lambda x: F.to_json(x))
        add("unique_items_violation", holds(F.when(value.items.isNotNull(), F.size(F.array_distinct(texts)) == F.size(texts))))
    if isinstance(s.get("contains"), dict | bool):
        n = size(F.filter(value.items, lambda x: sub(Value(x), s["contains"])))
        least = s.get("minContains", 1)
        add("min_contains_violation", holds(n >= (least if isinstance(least, int) else 1)))
        if isinstance(s.get("maxContains"), int):
            add("max_contains_violation", holds(n <= s["maxContains"]))
    if isinstance(s.get("anyOf"), list):
        add("anyof_violation", _or(sub(value, x) for x in s["anyOf"]))
    if isinstance(s.get("oneOf"), list):
        add("oneof_violation", reduce(lambda a, b: a + b, (sub(value, x).cast("int") for x in s["oneOf"]), F.lit(0)) == 1)
    if isinstance(s.get("not"), dict | bool):
        add("not_violation", ~sub(value, s["not"]))
    return out


def _lists(s: dict) -> tuple[dict, dict, list]:
    of = lambda k, kind: s[k] if isinstance(s.get(k), kind) else kind()
    return of("properties", dict), of("patternProperties", dict), of("prefixItems", list)


def _extra(value: Value, properties: dict, patterns: dict) -> Column:
    """Members that neither properties nor patterns name."""
    named = lambda e: (e["key"].isin(list(properties)) if properties else F.lit(False)) | _or(e["key"].rlike(p) for p in patterns if safe_pattern(p))
    return F.filter(value.members, lambda e: ~named(e))


def valid(value: Column | Value, s, root=None, depth: int = 0, stack: tuple[str, ...] = ()) -> Column:
    """Whether a variant satisfies a schema: true or false, never null."""
    value = value if isinstance(value, Value) else Value(value)
    root = s if root is None else root
    if depth > MAX_DEPTH:
        return F.lit(False)
    if isinstance(s, bool):
        return F.lit(s)
    if not isinstance(s, dict):
        return F.lit(True)
    if isinstance(s.get("$ref"), str):
        target, problem = _referred(s, root, stack)
        return F.lit(False) if problem else valid(value, target, root, depth + 1, (*stack, s["$ref"]))
    holds = lambda c: F.coalesce(c, F.lit(True))
    sub = lambda x, t: valid(x, t, root, depth + 1, stack)
    parts = [_type_ok(value, s["type"])] if "type" in s else []
    parts += [ok for _, _, ok, _ in _local(value, s, root, depth, stack)]
    properties, patterns, prefix = _lists(s)
    for i, t in enumerate(prefix):
        item = F.get(value.items, F.lit(i))
        parts.append(holds(item.isNull() | sub(Value(item), t)))
    if isinstance(s.get("items"), dict | bool):
        parts.append(holds(F.forall(_rest(value, prefix), lambda x: sub(Value(x), s["items"]))))
    is_object = value.kind == "object"
    parts += [holds(~is_object | value.has(k)) for k in s.get("required", []) if isinstance(k, str)]
    parts += [holds(~value.has(k) | sub(value.member(k), t)) for k, t in properties.items()]
    for p, t in patterns.items():
        fits = (lambda p, t: lambda e: ~e["key"].rlike(p) | sub(Value(e["value"]), t))(p, t)
        parts.append(holds(F.forall(value.members, fits)) if safe_pattern(p) else holds(F.size(value.members) <= 0))
    more = s.get("additionalProperties", True)
    if isinstance(more, dict) or more is False:
        parts.append(holds(F.forall(_extra(value, properties, patterns), lambda e: sub(Value(e["value"]), more))))
    if isinstance(s.get("propertyNames"), dict | bool):
        parts.append(holds(F.forall(value.members, lambda e: sub(Value(e["key"].cast("variant")), s["propertyNames"]))))
    for k, needed in s.get("dependentRequired", {}).items():
        parts.append(holds(~value.has(k) | _and(value.has(x) for x in needed)))
    parts += [holds(~value.has(k) | sub(value, t)) for k, t in s.get("dependentSchemas", {}).items()]
    parts += [sub(value, t) for t in s.get("allOf", [])]
    if isinstance(s.get("if"), dict | bool):
        parts.append(F.when(sub(value, s["if"]), sub(value, s.get("then", True))).otherwise(sub(value, s.get("else", True))))
    return _and(parts)


def _rest(value: Value, prefix: list) -> Column:
    return F.slice(value.items, F.lit(len(prefix) + 1), F.greatest(F.size(value.items) - len(prefix), F.lit(0))) if prefix else value.items


def _issue(when: Column, path: Column, code: str, severity: str, old: Column | None = None, new: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.when(when, F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(old).alias("old_value"), text(new).alias("new_value")))


def _found(value: Value, s, root, path: Column, present: Column, depth: int, stack: tuple[str, ...], one: list[Column], many: list[Column]) -> None:
    """Adds issues, null where there is none, to ``one``, and arrays of them to ``many``.  present: whether the value is there
    and the schema applies to it."""
    if isinstance(s, bool):
        if not s:
            one.append(_issue(present, path, "schema_false_violation", "warning", value.json))
        return
    if not isinstance(s, dict):
        return
    if depth > MAX_DEPTH:
        one.append(_issue(present, path, "schema_depth_limit", "error"))
        return
    if isinstance(s.get("$ref"), str):
        target, problem = _referred(s, root, stack)
        if problem:
            one.append(_issue(present, path, problem, "error"))
        else:
            _found(value, target, root, path, present, depth + 1, (*stack, s["$ref"]), one, many)
        return
    if "type" in s:
        ok = _type_ok(value, s["type"])
        one.append(_issue(present & ~ok, path, "schema_type_violation", "error", value.json))
        present = present & ok
    if value.plan:
        present = value._keep(present, 3)
    for code, severity, ok, new in _local(value, s, root, depth, stack):
        one.append(_issue(present & ~ok, path, code, severity, value.json, new))
    properties, patterns, prefix = _lists(s)
    below = lambda key: F.concat(path, F.lit("/" + escape(key)))
    is_object = present & (value.kind == "object")

    def missing(k: str, when: Column, code: str) -> None:
        own = properties.get(k)
        new = F.lit(json.dumps(own["default"], ensure_ascii=False)) if isinstance(own, dict) and "default" in own else None
        one.append(_issue(when & ~value.has(k), below(k), code, "warning", None, new))

    def deeper(x: Column, t, at: Column) -> Column:
        return collected(Value(x), t, root, at, F.lit(True), depth + 1, stack)

    for k in s.get("required", []):
        if isinstance(k, str):
            missing(k, is_object, "schema_required_missing")
    for k, needed in s.get("dependentRequired", {}).items():
        for x in needed:
            missing(x, is_object & value.has(k), "schema_dependent_required_missing")
    for k, t in properties.items():
        _found(value.member(k), t, root, below(k), is_object & value.has(k), depth + 1, stack, one, many)
    key_of = lambda e: F.concat(path, F.lit("/"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    plain = lambda e, code, severity: F.array(_issue(F.lit(True), key_of(e), code, severity, F.to_json(e["value"])))
    for p, t in sorted(patterns.items()):
        if safe_pattern(p):
            hit = F.filter(value.members, (lambda p: lambda e: e["key"].rlike(p))(p))
            many.append(F.when(is_object, F.flatten(F.transform(hit, (lambda t: lambda e: deeper(e["value"], t, key_of(e)))(t)))))
        else:
            many.append(F.when(is_object, F.flatten(F.transform(value.members, lambda e: plain(e, "schema_pattern_property_unsupported", "error")))))
    more = s.get("additionalProperties", True)
    if more is False:
        many.append(F.when(is_object, F.flatten(F.transform(_extra(value, properties, patterns), lambda e: plain(e, "schema_additional_property", "warning")))))
    elif isinstance(more, dict):
        many.append(F.when(is_object, F.flatten(F.transform(_extra(value, properties, patterns), lambda e: deeper(e["value"], more, key_of(e))))))
    if isinstance(s.get("propertyNames"), dict | bool):
        wrong = F.filter(value.members, lambda e: ~valid(e["key"].cast("variant"), s["propertyNames"], root, depth + 1, stack))
        many.append(F.when(is_object, F.flatten(F.transform(wrong, lambda e: plain(e, "schema_property_name_violation", "warning")))))
    for k, t in s.get("dependentSchemas", {}).items():
        _found(value, t, root, path, is_object & value.has(k), depth + 1, stack, one, many)
    for i, t in enumerate(prefix):
        item = F.get(value.items, F.lit(i))
        many.append(F.when(present & item.isNotNull(), deeper(item, t, F.concat(path, F.lit(f"/{i}")))))
    if isinstance(s.get("items"), dict | bool):
        at = lambda i: F.concat(path, F.lit("/"), (i + len(prefix)).cast("string"))
        many.append(F.when(present & value.items.isNotNull(), F.flatten(F.transform(_rest(value, prefix), lambda x, i: deeper(x, s["items"], at(i))))))
    for t in s.get("allOf", []):
        _found(value, t, root, path, present, depth + 1, stack, one, many)
    if isinstance(s.get("if"), dict | bool):
        test = valid(value, s["if"], root, depth + 1, stack)
        for branch, when in (("then", test), ("else", ~test)):
            if branch in s:
                _found(value, s[branch], root, path, present & when, depth + 1, stack, one, many)


def collected(value: Value, s, root, path: Column, present: Column, depth: int = 0, stack: tuple[str, ...] = ()) -> Column:
    """The issues of a value as an array."""
    one: list[Column] = []
    many: list[Column] = []
    _found(value, s, root, path, present, depth, stack, one, many)
    empty = F.array().cast(_ISSUE)
    return F.flatten(F.array(F.array_compact(F.array(*one)).cast(_ISSUE) if one else empty, *(F.coalesce(m, empty) for m in many)))


def openapi_schemas(document: dict) -> dict[str, dict]:
    """Component schemas of an OpenAPI document, each with the document as root of its references."""
    return {name: {"$ref": f"#/components/schemas/{name}"} for name in document.get("components", {}).get("schemas", {})}


def validate(df: DataFrame, raw: str, schema, root=None, column: str = "ok") -> DataFrame:
    """The given rows with whether their JSON text satisfies a schema; null for a text that can't be parsed."""
    plan = Plan()
    value = Value(plan.put(0, F.try_parse_json(F.col(raw))), plan, 0)
    ok = valid(value, schema, root)
    return plan.apply(df).select(*(F.col(f"`{c}`") for c in df.columns if c != column), F.when(value.v.isNotNull(), ok).alias(column))


def violations(df: DataFrame, key: str, raw: str, schema, root=None) -> DataFrame:
    """(row_id, path, code, severity, old_value, new_value): every violation at any depth, each once.  Values are JSON texts;
    new_value is the only admissible repair: the constant, the one member of an enumeration that differs by case, the nearest
    number that all numeric keywords admit, the default of a missing property."""
    plan = Plan()
    value = Value(plan.put(0, F.try_parse_json(F.col(raw))), plan, 0)
    found = collected(value, schema, schema if root is None else root, F.lit(""), value.v.isNotNull())
    return plan.apply(df).select(F.col(key).alias("row_id"), F.explode(F.array_distinct(found)).alias("i")).select("row_id", "i.*")


def boundary_status(x: Column, bounds: dict, integer: bool = False) -> tuple[Column, Column]:
    """(status, value) of a number under numeric keywords: VALID as it is, UNIQUE nearest value, AMBIGUOUS if two are as near,
    EMPTY if no number is admitted, NO_MINIMUM if values come ever nearer to an excluded bound, INVALID for no number."""
    s = dict(bounds, type="integer") if integer else dict(bounds)
    number = exact(x)
    low, high, step = _finite(s.get("minimum")), _finite(s.get("maximum")), _finite(s.get("multipleOf"))
    above, below = _finite(s.get("exclusiveMinimum")), _finite(s.get("exclusiveMaximum"))
    if integer:
        step = Fraction(1) if step is None else Fraction(step.numerator)
    if step is not None:
        if above is not None:
            low = max(v for v in (low, (above // step + 1) * step) if v is not None)
        if below is not None:
            high = min(v for v in (high, -(-below // step) * step - step) if v is not None)
        first = None if low is None else -(-low // step) * step
        empty = first is not None and high is not None and first > high
        open_ = F.lit(False)
    else:
        least, most = max((v for v in (low, above) if v is not None), default=None), min((v for v in (high, below) if v is not None), default=None)
        empty = least is not None and most is not None and (least > most or least == most and (least == above or most == below))
        open_ = F.lit(False)
        if above is not None and (low is None or above >= low):
            open_ = open_ | (number <= decimal(above))
        if below is not None and (high is None or below <= high):
            open_ = open_ | (number >= decimal(below))
    ok = _and(c for _, c in _numeric(s, number.cast(NUMBER), number.cast("double")))
    if integer:
        ok = ok & (number == F.floor(number).cast(DEC))
    near = project(x, low, high, step)
    status = F.when(number.isNull(), "INVALID").when(F.lit(empty), "EMPTY").when(ok, "VALID").when(open_, "NO_MINIMUM").when(near.isNull(), "AMBIGUOUS").otherwise("UNIQUE")
    return status, F.when(status.isin("VALID", "UNIQUE"), F.when(ok, number).otherwise(near))


def boundary_registry(schema, rules=()) -> list[dict]:
    """A schema's and declared rules' numeric bounds by field path, with whether they admit no number at all.  Bounds of one
    path from several places are met together."""
    found: dict[str, dict] = {}

    def meet(path: str, source: dict, integer: bool, origin: str) -> None:
        own = found.setdefault(path, {"path": path, "integer": False, "origins": []})
        own["integer"] |= integer
        own["origins"].append(origin)
        for k in ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf"):
            b = _finite(source.get(k))
            if b is not None:
                better = max if "Minimum" in k or k == "minimum" else min
                if k == "multipleOf" and k in own:  # on both lattices: multiples of the least common multiple
                    import math

                    a = own[k]
                    own[k] = Fraction(math.lcm(a.numerator, b.numerator), math.gcd(a.denominator, b.denominator))
                else:
                    own[k] = better(own[k], b) if k in own else b

    def walk(s, path: str, stack: tuple[str, ...]) -> None:
        if not isinstance(s, dict):
            return
        if isinstance(s.get("$ref"), str):
            target, problem = _referred(s, schema, stack)
            if not problem:
                walk(target, path, (*stack, s["$ref"]))
            return
        if any(_finite(s.get(k)) is not None for k in (*_BOUNDS, "multipleOf")):
            meet(path, s, s.get("type") == "integer", "schema")
        for k, t in _lists(s)[0].items():
            walk(t, f"{path}/{escape(k)}", stack)
        if isinstance(s.get("items"), dict):
            walk(s["items"], f"{path}/*", stack)
        for t in s.get("allOf", []):
            walk(t, path, stack)

    walk(schema, "", ())
    for r in rules:
        if r.kind in _BOUNDS or r.kind == "multipleOf":
            meet(f"/{escape(r.field)}", {r.kind: r.argument}, False, "rule")
    for own in found.values():
        low, high = own.get("minimum"), own.get("maximum")
        above, below = own.get("exclusiveMinimum"), own.get("exclusiveMaximum")
        step = own.get("multipleOf") or (Fraction(1) if own["integer"] else None)
        if step:
            lows = [-(-low // step) * step] if low is not None else []
            highs = [high // step * step] if high is not None else []
            lows += [(above // step + 1) * step] if above is not None else []
            highs += [-(-below // step) * step - step] if below is not None else []
            own["contradiction"] = bool(lows and highs and max(lows) > min(highs))
        else:
            lows, highs = [(v, v is above) for v in (low, above) if v is not None], [(v, v is below) for v in (high, below) if v is not None]
            own["contradiction"] = any(a > b or a == b and (x or y) for a, x in lows for b, y in highs)
    return [found[p] for p in sorted(found)]
