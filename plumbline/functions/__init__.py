"""Scalar functions: exact numbers, pointers, canonical JSON, text."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEC = "decimal(38,9)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same with a digit less, so that a sum of two has DEC's type and loses no place.
_TERM = "decimal(37,9)"


def let(values: dict[str, Column], body) -> Column:
    """body of a struct of the values, each of which is computed once however often body names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))


def exact(c: Column | str) -> Column:
    """Exact number of a value or of a numeric text; null for what is none, for booleans, and for a number that DEC can't
    hold digit by digit (nothing is rounded)."""
    c = col(c)
    kind, text = F.typeof(c), F.trim(c.cast("string"))
    pattern = r"^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,5}))?$"
    matched = {name: F.regexp_extract(text, pattern, i) for i, name in enumerate(("whole", "part", "power"), 1)}

    def number(m: Column) -> Column:
        # Digits of the mantissa, and places behind the point less the zeros at the end, moved by the exponent.
        digits = F.concat(m["whole"], m["part"])
        bare = F.rtrim(digits, F.lit("0"))
        places = F.length(m["part"]) - (F.length(digits) - F.length(bare)) - F.coalesce(m["power"].try_cast("int"), F.lit(0))
        return F.when((digits != "") & ((bare == "") | (places <= 9)), text.try_cast(DEC))

    # Most texts need no look at their digits: up to 28 before the point and nine behind it.
    plain = text.rlike(r"^[+-]?[0-9]{1,28}(?:\.[0-9]{1,9})?$")
    # Types are known when a plan is made, so only one branch of this is left in it.
    return (
        F.when(kind.isin("tinyint", "smallint", "int", "bigint") | kind.rlike(r"^decimal\([0-9]+,[0-9]\)$"), c.try_cast(DEC))
        .when(kind.isin("boolean", "date", "timestamp", "binary"), F.lit(None).cast(DEC))
        .otherwise(F.when(plain, text.try_cast(DEC)).otherwise(let(matched, number)))
    )


def plus(a: Column, b: Column) -> Column:
    """a + b of two DEC numbers, exactly; null beyond 28 digits before the point."""
    return (a.try_cast(_TERM) + b.try_cast(_TERM)).cast(DEC)


def minus(a: Column, b: Column) -> Column:
    return (a.try_cast(_TERM) - b.try_cast(_TERM)).cast(DEC)


def total(*terms: Column) -> Column:
    return reduce(plus, terms)


def times(a: Column, b: Column) -> Column:
    """a * b exactly; null if the product has more than nine places, or a factor 20 digits or the product 29 before the point.

    Whole and broken parts are multiplied apart, as a product of two DEC would come out rounded to six places."""
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("decimal(19,0)")

    def product(v: Column) -> Column:
        r, s = ((v[x].try_cast(_TERM) - v[y]).cast("decimal(9,9)") for x, y in (("a", "p"), ("b", "q")))
        small = (r * s).cast("decimal(18,18)")
        kept = small.cast("decimal(9,9)")
        return F.when(small == kept, total(F.try_multiply(v["p"], v["q"]).try_cast(_TERM), v["p"] * s, v["q"] * r, kept.cast(DEC)))

    return let({"a": a, "b": b}, lambda v: let({"a": v["a"], "b": v["b"], "p": whole(v["a"]), "q": whole(v["b"])}, product))


def over(a: Column, b: Column) -> Column:
    """a / b exactly; null for a division by zero, a quotient of more than nine places, or numbers of 19 digits before the
    point.  Both are taken as whole billionths; the remainder gives the places."""
    scaled = lambda x: (x.try_cast("decimal(27,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(27,0)")

    def quotient(v: Column) -> Column:
        n, d = v["n"], v["d"]
        rest = ((n % d) * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")
        whole, part = ((n - n % d) / d).try_cast("decimal(28,0)"), (rest / d).try_cast("decimal(10,0)")
        return F.when(rest % d == 0, (whole + part * F.lit("0.000000001").cast("decimal(9,9)")).try_cast(DEC))

    return let({"n": scaled(a), "d": scaled(F.nullif(b, F.lit(0).cast(DEC)))}, quotient)


def exact_equal(a: Column | str, b: Column | str) -> Column:
    return exact(a) == exact(b)


def exact_divide(a: Column | str, b: Column | str) -> Column:
    return over(exact(a), exact(b))


#: Quotients of whole numbers, which are given to 18 places.
LONG = "decimal(38,18)"


def finite_decimal(numerator: Column, denominator: Column) -> Column:
    """The quotient of two 64-bit integers if it has an exact decimal expansion of at most 18 places, else null."""
    def quotient(v: Column) -> Column:
        n, d = v["n"].cast("decimal(19,0)"), v["d"].cast("decimal(19,0)")
        rest = F.try_multiply(n % d, F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
        whole, part = ((n - n % d) / d).cast("decimal(19,0)"), (rest / d).cast("decimal(19,0)")
        return F.when(rest % d == 0, (whole + part * F.lit("0.000000000000000001").cast("decimal(18,18)")).try_cast(LONG))

    return let({"n": numerator.cast("bigint"), "d": F.nullif(denominator.cast("bigint"), F.lit(0).cast("bigint"))}, quotient)


def exact_root(x: Column, n: int) -> Column:
    """The n-th root of a DEC number if it is a whole number, or a number of up to four places, exactly; else null."""
    def root(v: Column) -> Column:
        x = v["x"].cast("double")
        size = F.pow(F.abs(x), F.lit(1.0 / n))
        guess = F.round(F.when(x >= 0, size).otherwise(F.negative(size) if n % 2 else F.lit(None)), 4).try_cast(DEC)
        return let({"g": guess, "x": v["x"]}, lambda w: F.when(power(w["g"], n) == w["x"], w["g"]))

    return let({"x": x}, root)


def power(x: Column, n: int) -> Column:
    """x to a whole power; negative ones by division."""
    if n < 0:
        return over(F.lit(1).cast(DEC), power(x, -n))
    out = F.lit(1).cast(DEC)
    for bit in bin(n)[2:] if n else "":
        out = times(out, out) if bit == "0" else times(times(out, out), x)
    return out


def number_text(x: Column) -> Column:
    """A DEC number as text without zeros at the end: 1 for 1.000000000."""
    return F.when(x == F.floor(x).cast(DEC), F.floor(x).cast("decimal(38,0)").cast("string")).otherwise(F.rtrim(x.cast("string"), F.lit("0")))


def canonical_number_like(x: Column, example: Column) -> Column:
    """The number as a JSON text in the style of an example's: a quoted text if that is one, with a point if that has one."""
    text = number_text(x)
    pointed = F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
    return F.when(example.startswith('"'), F.concat(F.lit('"'), text, F.lit('"'))).when(example.rlike("[.eE]"), pointed).otherwise(text)


def fold(c: Column | str) -> Column:
    """A text without differences of case: upper case, in which ß is SS and both small sigmas are one letter."""
    return F.upper(col(c))


def singular(name: str) -> str:
    """Singular of an English plural field name."""
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith("ses") or name.endswith("xes"):
        return name[:-2]
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def name_tokens(name: str) -> list[str]:
    return [t for t in name.lower().replace("-", "_").split("_") if t]


def affinity(a: str, b: str) -> float:
    """Share of name tokens in common."""
    x, y = set(name_tokens(a)), set(name_tokens(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def unescape(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def pointer(*parts: Column | str) -> Column:
    """JSON Pointer of path parts: strings are literals, columns are values."""
    token = lambda p: F.lit(escape(p)) if isinstance(p, str) else F.replace(F.replace(p.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(*(x for p in parts for x in (F.lit("/"), token(p))))


def json_path(pointer_text: str) -> str:
    """The JSON path of a pointer: digits index arrays."""
    out = "$"
    for token in pointer_text.split("/")[1:]:
        token = unescape(token)
        out += f"[{token}]" if token.isdigit() else f"['{token}']"
    return out


def glob_regex(pattern: str) -> str:
    """A pointer glob as a regular expression: * is any part of one token, ** any number of tokens."""
    import re

    token = lambda p: "[^/]*".join(map(re.escape, p.split("*")))
    return "^" + "".join("(?:/.*)?" if p == "**" else "/" + token(p) for p in pattern.split("/")[1:]) + "$"


def canonical(c: Column) -> Column:
    """Canonical JSON of a JSON text: keys sorted, no spaces; null if it isn't strict JSON."""
    return F.to_json(F.try_parse_json(c))


def digest(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def selector_bits(n: Column | str) -> Column:
    """Bits of a fixed-width selector among n choices."""
    n = col(n).cast("long")
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("long")


def seconds(c: Column | str) -> Column:
    """Seconds since the epoch of a timestamp or an ISO-8601 text; null if it is neither."""
    return F.unix_seconds(F.try_to_timestamp(col(c).cast("string")))


def iso_like(moment: Column, example: Column) -> Column:
    """A timestamp as ISO-8601 text in the style of an example: a date alone, a space or a T, with Z or without."""
    day = F.date_format(moment, "yyyy-MM-dd")
    gap = F.when(example.contains("T"), "T").otherwise(" ")
    return F.when(F.length(example) <= 10, day).otherwise(F.concat(day, gap, F.date_format(moment, "HH:mm:ss"), F.when(example.endswith("Z"), "Z").otherwise("")))


def merkle_root(df: DataFrame, row: Column, order: Column) -> DataFrame:
    """(n_rows, root): SHA-256 of the rows' digests by pairs, level by level, in the order of a column; a last one without
    a partner goes up as it is.  Each level is a grouped table half as long, so nothing is collected."""
    level = df.select(F.sha2(row, 256).alias("h"), F.row_number().over(Window.orderBy(order)).cast("long").alias("at")).withColumn("at", F.col("at") - 1)
    n = df.count()
    left = n
    while left > 1:
        pair = level.groupBy(F.expr("at DIV 2").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("two"))
        level = pair.select("at", F.when(F.size("two") == 1, F.get("two", F.lit(0))["h"]).otherwise(F.sha2(F.concat(F.get("two", F.lit(0))["h"], F.get("two", F.lit(1))["h"]), 256)).alias("h"))
        left = -(-left // 2)
    return level.select(F.lit(n).cast("long").alias("n_rows"), F.col("h").alias("root"))


def project(x: Column, low=None, high=None, step=None) -> Column:
    """The admissible value nearest to x between bounds, on the multiples of step if there is one; null if none exists or
    two are as near.  Bounds and step are numbers or Fractions; the value is exact."""
    low, high, step = (None if b is None else Fraction(str(b)) if not isinstance(b, Fraction) else b for b in (low, high, step))
    if step is not None:
        low = None if low is None else -((-low) // step) * step
        high = None if high is None else high // step * step
    if low is not None and high is not None and low > high:
        return F.lit(None).cast(DEC)
    def nearest(v: Column) -> Column:
        x = v["x"]
        if step is None:
            y = x if low is None else F.greatest(x, decimal(low))
            return y if high is None else F.least(y, decimal(high))
        below = F.pmod(x, decimal(step)).cast(DEC)
        lo = minus(x, below)
        hi = F.when(below == 0, lo).otherwise(plus(lo, decimal(step)))
        if high is not None:
            lo, hi = F.least(lo, decimal(high)), F.least(hi, decimal(high))
        if low is not None:
            lo, hi = F.greatest(lo, decimal(low)), F.greatest(hi, decimal(low))
        return let({"lo": lo, "hi": hi, "x": x}, lambda w: F.when((w["lo"] == w["hi"]) | (F.abs(minus(w["x"], w["lo"])) < F.abs(minus(w["hi"], w["x"]))), w["lo"]).when(F.abs(minus(w["x"], w["lo"])) > F.abs(minus(w["hi"], w["x"])), w["hi"]))

    return F.when(x.isNotNull(), let({"x": exact(x)}, nearest))


def decimal(number: Fraction | int | float | str) -> Column:
    """A DEC literal; a fraction without a decimal expansion of nine places is refused."""
    number = Fraction(str(number)) if not isinstance(number, Fraction) else number
    scaled = number * 10**9
    if scaled.denominator != 1:
        raise ValueError(f"{number} has more than nine places")
    sign, (whole, part) = "-" if scaled < 0 else "", divmod(abs(scaled.numerator), 10**9)
    return F.lit(f"{sign}{whole}.{part:09d}").cast(DEC)
