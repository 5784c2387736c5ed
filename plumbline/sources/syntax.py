"""Repair of nearly valid JSON texts: accepted only if all least repairs agree on one value.

The steps are lexical.  Each is one pass of a tokeniser that knows both kinds of quotes, so none touches what stands in a
string, and each takes time in proportion to the text.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
#: Largest number of edits, and of texts that a search looks at before it gives up.
MOST_EDITS, MOST_STATES = 2, 1024


def _pairs(items):
    if len(made := dict(items)) < len(items):
        raise ValueError("repeated key")
    return made


def _constant(name):
    raise ValueError(name)


def _number(digits):
    if not math.isfinite(value := float(digits)):
        raise ValueError("a number beyond a double")
    return value


_STRICT = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_number)


def parse_strict(text: str):
    """The value of a strict JSON text; ValueError for repeated keys, numbers that aren't finite and lone surrogates."""
    value = _STRICT.decode(text)
    text.encode()
    stack = [value] if "\\u" in text else []  # only an escape can make half of a pair
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            v.encode()
        elif isinstance(v, list | dict):
            stack += [*v, *v.values()] if isinstance(v, dict) else v
    return value


_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\[\s\S])*(?:"|\Z)', r"'(?:[^'\\]|\\[\s\S])*'"
_TOKENS = re.compile(rf"(?P<quoted>{_DOUBLE}|{_SINGLE})|(?P<line>//[^\r\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<open>/\*)")
_BARE = re.compile(rf"(?P<quoted>{_DOUBLE}|{_SINGLE})|(?P<before>[{{,]\s*)(?P<key>[^\W\d][\w$-]*)(?=\s*:)")
_COMMA = re.compile(rf"(?P<quoted>{_DOUBLE}|{_SINGLE})|,(?=\s*[}}\]])")
_QUOTES = re.compile(rf"{_DOUBLE}|(?P<single>{_SINGLE})|(?P<open>')")


def strip_comments(text: str) -> str:
    """Without // and /* */ comments; a block leaves a space, so what stood apart stays apart.  The text as it is if a block
    isn't closed."""
    open_ = False

    def edit(m):
        nonlocal open_
        open_ |= m["open"] is not None
        return m[0] if m["quoted"] is not None else " " if m["block"] is not None else ""

    new = _TOKENS.sub(edit, text)
    return text if open_ else new


def single_quotes(text: str) -> str:
    """Single-quoted strings as double-quoted ones; the text as it is if one isn't closed."""
    open_ = False

    def edit(m):
        nonlocal open_
        open_ |= m["open"] is not None
        if m["single"] is None:
            return m[0]
        inner = re.sub(r"\\[\s\S]|\"", lambda e: {"\\'": "'", '"': '\\"'}.get(e[0], e[0]), m["single"][1:-1])
        return f'"{inner}"'

    new = _QUOTES.sub(edit, text)
    return text if open_ else new


def quote_keys(text: str) -> str:
    """Bare names before a colon, behind an opening brace or a comma, as strings."""
    return _BARE.sub(lambda m: m[0] if m["quoted"] is not None else f'{m["before"]}"{m["key"]}"', text)


def trailing_commas(text: str) -> str:
    return _COMMA.sub(lambda m: m[0] if m["quoted"] is not None else "", text)


STEPS = (("bom", lambda t: t.removeprefix(BOM)), ("comments", strip_comments), ("single_quotes", single_quotes), ("unquoted_keys", quote_keys), ("trailing_comma", trailing_commas))


def _unclosed(text: str) -> str:
    """What closes the string and the containers that are open at the end."""
    stack, inside = [], False
    for m in re.finditer(r'\\.|["{}\[\]]', text, re.S):
        c = m[0]
        if c == '"':
            inside = not inside
        elif not inside and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and stack:
            stack.pop()
    return ('"' if inside else "") + "".join(reversed(stack))


def frontier(text: str, at: int) -> Iterator[str]:
    """Texts one edit away from one that can't be parsed beyond a place: a delimiter less or more around it, a string closed
    before the brackets at the end, or everything that is open closed."""
    for p in range(max(0, at - 2), min(len(text), at + 3)):
        if text[p] in ",:]}{[":
            yield text[:p] + text[p + 1 :]
    for p in range(max(0, at - 1), min(len(text), at + 2) + 1):
        for c in ",:}]":
            yield text[:p] + c + text[p:]
    if missing := _unclosed(text):
        yield text + missing
        if missing.startswith('"'):
            body = text.rstrip()
            inner = body.rstrip("}]")
            yield inner + '"' + body[len(inner) :]


def repair(text: str | None, edits: int = MOST_EDITS, states: int = MOST_STATES) -> tuple[str | None, str]:
    """(canonical JSON or None, how): valid as it is, by the lexical steps, or by the fewest edits; None if refused.  A text
    that fails for a repeated key, a number that isn't finite or a lone surrogate is refused: no edit of its grammar says
    what was meant.  So is one whose search isn't over after so many texts, as a least repair may not have been seen."""
    if text is None:
        return None, "refused"

    def value(t):
        return json.dumps(parse_strict(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

    try:
        return value(text), "valid"
    except json.JSONDecodeError:
        pass
    except (ValueError, RecursionError):
        return None, "refused"
    now, used = text, []
    for name, step in STEPS:
        new = step(now)
        if new != now:
            used.append(name)
            now = new
    try:
        return value(now), "+".join(used)
    except json.JSONDecodeError:
        pass
    except (ValueError, RecursionError):
        return None, "refused"
    queue, seen, found, best, order = [(0, 0, now)], {now}, set(), None, 0
    while queue:
        cost, _, t = heapq.heappop(queue)
        if best is not None and cost > best:
            break
        try:
            found.add(value(t))
            best = cost
            continue
        except json.JSONDecodeError as e:
            at = e.pos
        except (ValueError, RecursionError):
            continue
        if cost >= edits or best is not None:
            continue
        for new in frontier(t, at):
            if new not in seen:
                if len(seen) >= states:
                    return None, "refused"
                seen.add(new)
                order += 1
                heapq.heappush(queue, (cost + 1, order, new))
    return (found.pop(), f"edits:{best}") if len(found) == 1 else (None, "refused")


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("how", T.StringType())]))
def repaired(texts: pd.Series) -> pd.DataFrame:
    """Column form of ``repair``; rows are independent, so it is one Arrow batch after the other."""
    return pd.DataFrame([repair(t) for t in texts], columns=["value", "how"])
