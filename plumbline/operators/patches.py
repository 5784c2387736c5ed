"""JSON patches on documents: pointers, operations with exact inverses, atomic plans.

Documents are JSON texts, a row each; pointers reach any depth, so the work is done on parsed values in Arrow batches.
"""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unescape
from ..sources.syntax import parse_strict


class PatchError(ValueError):
    """An operation that can't be done; the document stays as it was."""


def equal(a, b) -> bool:
    """Deep equality with types: 1 is 1.0, true is not 1, objects don't depend on the order of their keys."""
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return type(a) is type(b) and a == b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b


def tokens(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise PatchError(f"no pointer: {pointer}")
    return [unescape(t) for t in pointer[1:].split("/")]


def _index(items: list, token: str, end: bool = False) -> int:
    if end and token == "-":
        return len(items)
    if not token.isascii() or not token.isdigit() or token != str(int(token)) or int(token) >= len(items) + end:
        raise PatchError(f"no such position: {token}")
    return int(token)


def get(document, pointer: str):
    for token in tokens(pointer):
        if isinstance(document, dict) and token in document:
            document = document[token]
        elif isinstance(document, list):
            document = document[_index(document, token)]
        else:
            raise PatchError(f"nothing at {pointer}")
    return document


def _parent(document, pointer: str):
    path = tokens(pointer)
    if not path:
        raise PatchError("the whole document has no parent")
    return get(document, pointer[: pointer.rindex("/")]), path[-1]


def _one(document, op: dict):
    """(document, inverse operations) of one operation; the document may be changed in place."""
    kind, path = op["op"], op.get("path", "")
    if kind == "test":
        if not equal(get(document, path), op["value"]):
            raise PatchError(f"{path} has another value")
        return document, []
    if kind == "plan":
        return apply(document, op["operations"])
    if kind == "copy":
        return _one(document, {"op": "add", "path": path, "value": copy.deepcopy(get(document, op["from"]))})
    if kind == "move":
        source = op["from"]
        if path == source:
            get(document, path)
            return document, []
        if path.startswith(source + "/"):
            raise PatchError("a value can't move into itself")
        value = copy.deepcopy(get(document, source))
        document, back = _one(document, {"op": "remove", "path": source})
        document, undo = _one(document, {"op": "add", "path": path, "value": value})
        return document, undo + back
    if kind == "replace":
        old = copy.deepcopy(get(document, path))
        if "old" in op and not equal(old, op["old"]):
            raise PatchError(f"{path} has another value than expected")
        if path == "":
            return op["value"], [{"op": "replace", "path": "", "value": old}]
        parent, token = _parent(document, path)
        parent[token if isinstance(parent, dict) else _index(parent, token)] = copy.deepcopy(op["value"])
        return document, [{"op": "replace", "path": path, "value": old}]
    if kind == "add":
        if path == "":
            return op["value"], [{"op": "replace", "path": "", "value": document}]
        parent, token = _parent(document, path)
        if isinstance(parent, list):
            at = _index(parent, token, end=True)
            parent.insert(at, copy.deepcopy(op["value"]))
            return document, [{"op": "remove", "path": f"{path[: path.rindex('/')]}/{at}"}]
        if not isinstance(parent, dict):
            raise PatchError(f"{path} lies in no container")
        undo = [{"op": "replace", "path": path, "value": parent[token]}] if token in parent else [{"op": "remove", "path": path}]
        parent[token] = copy.deepcopy(op["value"])
        return document, undo
    if kind == "remove":
        old = get(document, path)
        parent, token = _parent(document, path)
        if isinstance(parent, dict):
            # An inverse by order too: the members behind it are taken out and put back.
            del parent[token]
        else:
            del parent[_index(parent, token)]
        return document, [{"op": "add", "path": path, "value": old}]
    raise PatchError(f"unknown operation {kind}")


def apply(document, operations: list[dict]):
    """(new document, inverse operations in the order in which they undo).  All or nothing: the given document isn't touched,
    and PatchError is raised at the first operation that can't be done."""
    now, undo = copy.deepcopy(document), []
    for op in operations:
        now, back = _one(now, op)
        undo = back + undo
    return now, undo


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


_DONE = T.StructType([T.StructField("value", T.StringType()), T.StructField("inverse", T.StringType()), T.StructField("status", T.StringType())])


@F.pandas_udf(_DONE)
def patched(raw: pd.Series, operations: pd.Series) -> pd.DataFrame:
    """(value, inverse, status) of a document and a JSON array of operations: APPLIED, REFUSED (the value is then the
    document as it was), or INVALID for texts that aren't JSON.  Values are canonical JSON."""
    out = []
    for text, ops in zip(raw, operations, strict=True):
        try:
            document, todo = parse_strict(text), parse_strict(ops)
        except (ValueError, TypeError, RecursionError):
            out.append((None, None, "INVALID"))
            continue
        try:
            new, undo = apply(document, todo)
            out.append((_text(new), _text(undo), "APPLIED"))
        except (PatchError, KeyError, TypeError):
            out.append((_text(document), "[]", "REFUSED"))
    return pd.DataFrame(out, columns=["value", "inverse", "status"])


@F.pandas_udf(T.StringType())
def _get(raw: pd.Series, pointer: pd.Series) -> pd.Series:
    out = []
    for text, path in zip(raw, pointer, strict=True):
        try:
            out.append(_text(get(parse_strict(text), path)))
        except (ValueError, TypeError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype=object)


def get_at(raw: Column, pointer: Column) -> Column:
    """JSON text of what a pointer names; null where there is nothing."""
    return _get(raw, pointer)


def set_at(raw: Column, pointer: Column, value: Column) -> Column:
    """The document with a value (JSON text) set, as a member or in place of what is there; null where its parent is missing."""
    here = get_at(raw, pointer)
    kind = F.when(here.isNull(), "add").otherwise("replace")
    done = patched(raw, F.concat(F.lit('[{"op":"'), kind, F.lit('","path":'), F.to_json(pointer.cast("variant")), F.lit(',"value":'), value, F.lit("}]")))
    return F.when(done["status"] == "APPLIED", done["value"])


def delete_at(raw: Column, pointer: Column) -> Column:
    """The document without what a pointer names; null where there is nothing."""
    done = patched(raw, F.concat(F.lit('[{"op":"remove","path":'), F.to_json(pointer.cast("variant")), F.lit("}]")))
    return F.when(done["status"] == "APPLIED", done["value"])


def patch_documents(docs: DataFrame, key: str, raw: str, patches: DataFrame) -> DataFrame:
    """docs with value, inverse and status.  patches: (row_id, seq, op, path, source, value), value as JSON text; those of a
    row are one atomic plan in the order of seq."""
    quoted = lambda c: F.to_json(F.col(c).cast("variant"))
    item = F.concat(F.lit('{"op":'), quoted("op"), F.lit(',"path":'), quoted("path"), F.when(F.col("source").isNotNull(), F.concat(F.lit(',"from":'), quoted("source"))).otherwise(F.lit("")), F.when(F.col("value").isNotNull(), F.concat(F.lit(',"value":'), "value")).otherwise(F.lit("")), F.lit("}"))
    todo = patches.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("op")))).alias("all")).select(F.col("row_id").alias("_row"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["op"]), ","), F.lit("]")).alias("_ops"))
    joined = docs.join(todo, F.col(key) == F.col("_row"), "left").withColumn("_done", patched(F.col(raw), F.coalesce("_ops", F.lit("[]"))))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("_done.value").alias("value"), F.col("_done.inverse").alias("inverse"), F.col("_done.status").alias("status"))
