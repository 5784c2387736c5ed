"""Readers and writers: strict JSON texts, record files, bundles of documents, reports."""

from __future__ import annotations

import json
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import escape
from .syntax import parse_strict

#: Bounds beyond which a document is refused, never truncated.
MAX_TEXT, MAX_DEPTH, MAX_NUMBER, MAX_NODES = 64 << 20, 96, 4096, 1_000_000
MAX_STRING, MAX_KEY, MAX_KEYS, MAX_ITEMS = 8 << 20, 16 << 10, 100_000, 1_000_000
MAX_DOCUMENTS, MAX_BUNDLE = 2048, 512 << 20
BOM = "\ufeff"
#: A JSON string.  Possessive, so that matching neither goes back nor grows the stack with the text.
STRING = r'"(?:[^"\\]++|\\.)*+"'


def without_bom(raw: Column) -> Column:
    return F.when(raw.startswith(BOM), F.substr(raw, F.lit(2))).otherwise(raw)


def outside_strings(raw: Column) -> Column:
    """The text with every closed string as an empty one."""
    return F.regexp_replace(raw, rf"(?s){STRING}", '""')


def lone_surrogate(raw: Column) -> Column:
    """Whether an escape names half of a surrogate pair.  Pairs of backslashes go first, so what is left begins an escape."""
    bare = F.replace(raw, F.lit("\\\\"), F.lit("  "))
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return raw.contains("\\u") & bare.rlike(f"{high}(?!{low})|(?<!{high}){low}")


def boundless_number(raw: Column) -> Column:
    """Whether a number is beyond the range of a double."""
    bare = outside_strings(raw)
    far = F.exists(F.regexp_extract_all(bare, F.lit(r"-?[0-9][0-9.]*(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda n: F.coalesce(F.abs(n.try_cast("double")) == float("inf"), F.lit(False)))
    return bare.rlike("[0-9][eE]|[0-9]{300}") & far


def strict(raw: Column) -> Column:
    """Variant of a strict JSON text: one value and nothing behind it.  Repeated keys, NaN, infinities and numbers beyond a
    double, and lone surrogates give null; a byte order mark is skipped.

    The parser stops behind the first value.  Text behind it can't be right both inside an array and as a member's value,
    so the text is parsed as each."""
    text = without_bom(raw)
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("\n}")))
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]"))).isNotNull()
    return F.when(alone & ~lone_surrogate(text) & ~boundless_number(text), F.try_variant_get(member, "$.v", "variant"))


def _structure(raw: Column) -> Column:
    """struct(now, top, widest, counts): how deep the text ends and gets, the most members of a container, and the members
    so far of the open ones, from the brackets and commas outside strings."""
    marks = F.regexp_replace(F.regexp_replace(outside_strings(raw), r"[\[{]\s*+[\]}]", ""), r"[^\[\]{},]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"), F.lit(0).alias("widest"), F.array().cast("array<int>").alias("counts"))

    def step(acc: Column, c: Column) -> Column:
        opened = F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["top"], acc["now"] + 1).alias("top"), F.greatest(acc["widest"], F.lit(1)).alias("widest"), F.concat(F.array(F.lit(1)), acc["counts"]).alias("counts"))
        closed = F.struct((acc["now"] - 1).alias("now"), acc["top"].alias("top"), acc["widest"].alias("widest"), F.slice(acc["counts"], F.lit(2), F.greatest(F.size(acc["counts"]) - 1, F.lit(0))).alias("counts"))
        more = F.coalesce(F.get(acc["counts"], F.lit(0)), F.lit(0)) + 1
        next_ = F.struct(acc["now"].alias("now"), acc["top"].alias("top"), F.greatest(acc["widest"], more).alias("widest"), F.concat(F.array(more), F.slice(acc["counts"], F.lit(2), F.greatest(F.size(acc["counts"]) - 1, F.lit(0)))).alias("counts"))
        return F.when(c.isin("[", "{"), opened).when(c.isin("]", "}"), closed).otherwise(next_)

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), zero, step)


def depth(raw: Column) -> Column:
    """Nesting depth of a JSON text, empty containers included: strings are taken out, then openings and closings are summed
    along the text."""
    bare = F.regexp_replace(outside_strings(raw), r"[^\[\]{}]", "")
    level = lambda acc, c: acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
    step = lambda acc, c: F.struct(level(acc, c).alias("now"), F.greatest(acc["top"], level(acc, c)).alias("top"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda a: a["top"])


def nodes(raw: Column) -> Column:
    """Values in a JSON text: one, and for each container that isn't empty one more than it has commas."""
    bare = outside_strings(raw)
    filled = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\[{]\s*+[\]}]"))
    return F.regexp_count(bare, F.lit(",")) + filled + 1


def longest_string(raw: Column) -> Column:
    """Characters of the longest string between its quotes, keys included."""
    found = F.regexp_extract_all(raw, F.lit(rf"(?s){STRING}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda s: F.char_length(s) - 2)), F.lit(0))


def longest_key(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit(rf"(?s)({STRING})\s*+:"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda s: F.char_length(s) - 2)), F.lit(0))


def within_limits(raw: Column, text: int = MAX_TEXT, levels: int = MAX_DEPTH, number: int = MAX_NUMBER, most_nodes: int = MAX_NODES, width: int = MAX_KEYS, string: int = MAX_STRING, key: int = MAX_KEY) -> Column:
    """Whether a text stays within all bounds.  What is cheap is tried first, and no container is wider than there are
    nodes, so widths are only counted in a text that could break that bound."""
    bare = outside_strings(raw)
    wide = F.when(nodes(raw) > width, _structure(raw)["widest"] <= width).otherwise(F.lit(True))
    lengths = F.when(F.char_length(raw) > min(string, key), (longest_string(raw) <= string) & (longest_key(raw) <= key)).otherwise(F.lit(True))
    return (F.octet_length(raw) <= text) & F.when(F.octet_length(raw) <= text, ~bare.rlike(rf"[0-9]{{{number},}}") & (nodes(raw) <= most_nodes) & (depth(raw) <= levels) & lengths & wide & ~lone_surrogate(raw)).otherwise(F.lit(False))


def format_of(path: str) -> str:
    return "jsonl" if path.lower().endswith((".jsonl", ".ndjson")) else "array"


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(line, raw, value): records of a JSONL file, blank lines skipped, or of a file with one top-level array (which is one
    split, as its records have no line ends)."""
    if (kind or format_of(path)) == "jsonl":
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"), F.col("_metadata.file_block_start").alias("block"))
        # A file's first line may have a mark.  Which line that is no column tells, so lines of the first block may.
        lines = lines.select("line", F.when(F.col("block") == 0, without_bom(F.col("raw"))).otherwise(F.col("raw")).alias("raw"))
        return lines.where("trim(raw) <> ''").withColumn("value", F.when(~F.col("raw").startswith(BOM), strict(F.col("raw"))))
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.try_variant_get(strict(F.col("value")), "$", "array<variant>")).alias("line", "value"))
    return whole.select(F.col("line").cast("long").alias("line"), F.to_json("value").alias("raw"), "value")


def read_document(spark: SparkSession, path: str, limit: int = MAX_TEXT) -> DataFrame:
    """(name, raw, value): a whole JSON file; one of more than ``limit`` bytes is refused before it is read."""
    return _read_files(spark, [path], limit, 1, limit)


def _read_files(spark: SparkSession, paths: list[str], limit: int, count: int, together: int, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json") if recursive else spark.read.format("binaryFile")
    listed = reader.option("recursiveFileLookup", recursive).load(paths).select("path", "length")  # the contents aren't read
    found = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("most")).first()
    if (found["n"] or 0) > count or (found["total"] or 0) > together or (found["most"] or 0) > limit:
        raise ValueError(f"{found['n']} files of {found['total']} bytes, the largest of {found['most']}, are beyond the limits")
    text = spark.read.option("recursiveFileLookup", recursive)
    text = (text.option("pathGlobFilter", "*.json") if recursive else text).text(paths, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("raw"), F.when(within_limits(F.col("value")), strict(F.col("value"))).alias("value"))


def read_bundle(spark: SparkSession, folder: str, count: int = MAX_DOCUMENTS, together: int = MAX_BUNDLE, limit: int = MAX_TEXT) -> DataFrame:
    """(name, raw, value): all .json documents below a folder, name being the path below it.  Too many, too large a
    document, too much in all, or a file that a link leads out of the folder is refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    root = top.getFileSystem(conf).resolvePath(top).toString().rstrip("/")
    if root.startswith("file:"):  # only local folders have links that the listing follows
        import os

        local = os.path.realpath(root.removeprefix("file:"))
        for here, folders, files in os.walk(local):
            for name in [*folders, *files]:
                if not os.path.realpath(os.path.join(here, name)).startswith(local + os.sep):
                    raise ValueError(f"{name} lies outside of the bundle")
    found = _read_files(spark, [folder], limit, count, together, recursive=True)
    below = F.regexp_replace("name", "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else root + "/"
    return found.withColumn("name", F.when(below.startswith(base), F.substr(below, F.lit(len(base) + 1))).otherwise(F.col("name")))


#: Most sources that a manifest may name.
MAX_SOURCES = 256


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, role, independent_group, line, raw, value): the records of all sources that a manifest names: a JSON list of
    {source_id, role, independent_group, path}, paths relative to the manifest.  Repeated ids, unknown members, paths that
    leave the folder and more than MAX_SOURCES are refused."""
    listed = parse_strict(read_document(spark, path).first()["raw"])
    if not isinstance(listed, list) or len(listed) > MAX_SOURCES or any(set(s) != {"source_id", "role", "independent_group", "path"} for s in listed):
        raise ValueError(f"a list of at most {MAX_SOURCES} sources with id, role, group and path")
    if any(s["path"].startswith("/") or ".." in s["path"].split("/") for s in listed):
        raise ValueError("a source lies outside of the manifest's folder")
    base = path.rsplit("/", 1)[0]
    return with_role([(s["source_id"], s["role"], s["independent_group"], read_records(spark, f"{base}/{s['path']}")) for s in listed])


def with_role(sources: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """Context tables (source_id, role, independent_group, rows) under one roof; ids must differ."""
    if len({s for s, *_ in sources}) < len(sources):
        raise ValueError("source ids must differ")
    out = None
    for source_id, role, group, df in sources:
        one = df.withColumns({"source_id": F.lit(source_id), "role": F.lit(role), "independent_group": F.lit(group)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def object_arrays(raw: Column) -> Column:
    """Names of top-level fields that hold an array of at least three objects."""
    members = F.map_entries(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"))
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    good = F.filter(members, lambda e: (F.size(items(e["value"])) >= 3) & F.forall(items(e["value"]), lambda x: F.schema_of_variant(x).startswith("OBJECT")))
    return F.array_sort(F.transform(good, lambda e: e["key"]))


_ENTRY = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())])


def _walk(value, arrays: bool, inner: bool):
    """(path, JSON text, kind) of a parsed value's nodes in document order; a stack instead of recursion."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        own = isinstance(v, dict) or arrays and isinstance(v, list)
        if inner or not own:
            kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "integer" if isinstance(v, int) else "number"
            yield path, json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")), kind
        if own:
            items = list(v.items()) if isinstance(v, dict) else list(enumerate(v))
            stack += [(f"{path}/{escape(str(k))}", x) for k, x in reversed(items)]


def _walker(arrays: bool, inner: bool):
    @F.pandas_udf(T.ArrayType(_ENTRY))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(None if text is None else list(_walk(parse_strict(text), arrays, inner)))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out)

    return run


def leaves(raw: Column) -> Column:
    """array<struct<path, value, kind>>: scalar leaves of nested objects at any depth; arrays are values.  Null for a text
    that isn't strict JSON.  Depth has no bound that a column expression could be written for, so this is an Arrow UDF."""
    return _walker(arrays=False, inner=False)(raw)


def tree(raw: Column) -> Column:
    """array<struct<path, value, kind>>: every node, containers and their members, items of arrays by position."""
    return _walker(arrays=True, inner=True)(raw)


_OBJECT = T.StructType([T.StructField("path", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("value", T.StringType())])


def objects(raw: Column, having: tuple[tuple[str, ...], ...] | None = None) -> Column:
    """array<struct<path, keys, value>>: every object at any depth with its keys in order, without values; or only objects
    that have a key of each group in ``having``, with their JSON texts.  Null for a text that isn't strict JSON.  Only what
    holds something is visited and nothing is written that isn't asked for, which ``tree`` does for every node."""

    @F.arrow_udf(T.ArrayType(_OBJECT))
    def run(texts: pa.Array) -> pa.Array:
        ends, paths, keys, key_ends, values, n = [], [], [], [0], [], 0
        for text in texts.to_pylist():
            start = n
            try:
                stack = [] if text is None else [("", parse_strict(text))]
            except (ValueError, RecursionError):
                text = None
            if text is None:
                ends.append(None)
                continue
            while stack:
                path, v = stack.pop()
                if isinstance(v, dict):
                    if having is None or all(any(k in v for k in group) for group in having):
                        paths.append(path)
                        keys += sorted(v)
                        key_ends.append(len(keys))
                        values.append(None if having is None else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
                        n += 1
                    items = [(k, x) for k, x in v.items() if isinstance(x, dict | list)]
                elif isinstance(v, list):
                    items = [(i, x) for i, x in enumerate(v) if isinstance(x, dict | list)]
                else:
                    continue
                items.reverse()
                stack += [(f"{path}/{k if isinstance(k, int) else escape(k)}", x) for k, x in items]
            ends.append(start)
        ends.append(n)
        own = pa.ListArray.from_arrays(pa.array(key_ends, pa.int32()), pa.array(keys, pa.string()))
        found = pa.StructArray.from_arrays([pa.array(paths, pa.string()), own, pa.array(values, pa.string())], names=["path", "keys", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return run(raw)


def object_array_paths(raw: Column, least: int = 3) -> Column:
    """Pointers of all arrays, at any depth, of at least so many items that are all objects."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found, stack = [], []
            try:
                stack = [] if text is None else [("", parse_strict(text))]
            except (ValueError, RecursionError):
                text = None
            while stack:
                path, v = stack.pop()
                if isinstance(v, list) and len(v) >= least and all(isinstance(x, dict) for x in v):
                    found.append(path)
                items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
                stack += [(f"{path}/{escape(str(k))}", x) for k, x in items]
            out.append(None if text is None else sorted(found))
        return pd.Series(out)

    return run(raw)


def write_records(df: DataFrame, path: str, order: str) -> None:
    """JSONL in the order of a column; each task's file becomes visible only when the job commits."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*(c for c in df.columns if c != order))).alias("value")).write.mode("overwrite").text(path)


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def publish(spark: SparkSession, stage: str, final: str) -> None:
    """Renames a staged folder or file to its final name.  What was there stands aside until the rename has worked and comes
    back if it hasn't, so one of the two is always whole."""
    fs, source = _hadoop(spark, stage)
    _, target = _hadoop(spark, final)
    _, aside = _hadoop(spark, f"{final.rstrip('/')}.before-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"can't move {final} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"can't publish {final}")
    if had:
        fs.delete(aside, True)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under a staging name first, then all renamed: a report is whole or absent."""
    spark = next(iter(tables.values())).sparkSession
    stage = f"{folder.rstrip('/')}.staging"
    fs, path = _hadoop(spark, stage)
    fs.delete(path, True)
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
    publish(spark, stage, folder)


def write_json(spark: SparkSession, value, path: str) -> None:
    """One document as indented JSON: written under another name, closed, read back and renamed."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    stage = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    fs, target = _hadoop(spark, stage)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    if fs.getFileStatus(target).getLen() != len(text.encode()):
        raise OSError(f"{path} was not written whole")
    publish(spark, stage, path)


def write_bundle(documents: DataFrame, folder: str) -> int:
    """documents: (name, value as JSON text).  Writes each as a file below a staging folder, reads all back as strict JSON,
    compares their digests, and only then renames the folder.  Names that leave the folder, that come twice or whose text is
    no strict JSON are refused before anything is written.  Returns the number of documents, MAX_DOCUMENTS at most."""
    spark = documents.sparkSession
    name = F.col("name")
    wrong = documents.where(name.isNull() | name.startswith("/") | F.array_contains(F.split(name, "/"), "..") | ~name.endswith(".json") | strict(F.col("value")).isNull())
    if not wrong.isEmpty():
        raise ValueError("a document's name leaves the folder or its text is not strict JSON")
    rows = documents.select("name", "value").limit(MAX_DOCUMENTS + 1).collect()  # a bundle's size is bounded
    if len(rows) > MAX_DOCUMENTS or len({r["name"] for r in rows}) < len(rows) or sum(len(r["value"]) for r in rows) > MAX_BUNDLE:
        raise ValueError("too many documents, or a name comes twice")
    stage = f"{folder.rstrip('/')}.staging"
    fs, path = _hadoop(spark, stage)
    fs.delete(path, True)
    fs.mkdirs(path)
    for r in rows:
        write_json(spark, parse_strict(r["value"]), f"{stage}/{r['name']}")
    want = {r["name"]: json.dumps(parse_strict(r["value"]), sort_keys=True) for r in rows}
    back = {r["name"]: json.dumps(parse_strict(r["raw"]), sort_keys=True) for r in read_bundle(spark, stage).collect()} if rows else {}
    if want != back:
        raise OSError("the staged documents differ from what was to be written")
    publish(spark, stage, folder)
    return len(rows)


# The exit code of each status of a run.
EXIT_CODES = {
    "PASS": 0,
    "STABLE_WITH_REPORTED_ISSUES": 10,
    "OPEN_REPAIRABLE": 11,
    "INPUT_ERROR": 20,
    "SECURITY_REFUSAL": 21,
    "IO_ERROR": 30,
    "INTERNAL_ERROR": 70,
}


def envelope(status: str, **facts) -> tuple[str, int]:
    """(canonical JSON of one object, exit code) that tells a machine how a run ended."""
    if status not in EXIT_CODES:
        raise ValueError(f"unknown status {status}")
    return json.dumps({"status": status, "exit_code": EXIT_CODES[status], **facts}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False), EXIT_CODES[status]
