"""Certificates: digests of tables, hash-linked proofs, cold replay, open obligations, the typed form of an analysis."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repair as rp
from .conflicts import prefixes
from .repair import CELL


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: its columns by name as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, row: Column | None = None) -> DataFrame:
    """(n_rows, low, high): of a table, whatever the order and the partitions of its rows.  Sums of the rows' digests, so that
    a repeated row counts as often as it comes and none cancels another."""
    part = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
    return df.select((row_digest(df) if row is None else row).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(part(1), F.lit(0).cast("decimal(38,0)")).alias("low"), F.coalesce(part(15), F.lit(0).cast("decimal(38,0)")).alias("high"))


def _hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class Proof:
    """A graph of statements, each with the hash of what it says and of the statements that it rests on.  Statements are about
    tables, by their digests; there are a few for each step of a run."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}

    def add(self, kind: str, says: dict, *parents: str) -> str:
        for p in parents:
            if p not in self.nodes:
                raise ValueError(f"unknown statement {p}")
        body = {"kind": kind, "says": says, "parents": sorted(parents)}
        name = _hash(body)
        self.nodes[name] = body
        return name

    def add_table(self, kind: str, df: DataFrame, *parents: str) -> str:
        return self.add(kind, table_digest(df).first().asDict(), *parents)

    def problems(self) -> list[str]:
        """Statements whose hash isn't that of their content, or that rest on missing ones."""
        return sorted(n for n, body in self.nodes.items() if _hash(body) != n or any(p not in self.nodes for p in body["parents"]))

    def root(self) -> str:
        """One hash for the whole graph."""
        return _hash(sorted(self.nodes))

    def packet(self) -> str:
        return json.dumps({"root": self.root(), "nodes": self.nodes}, sort_keys=True, separators=(",", ":"), default=str)

    @classmethod
    def open(cls, packet: str) -> Proof:
        """The graph of a packet; ValueError if it has been changed."""
        read, out = json.loads(packet), cls()
        out.nodes = read["nodes"]
        if out.problems() or out.root() != read["root"]:
            raise ValueError("the packet's hashes don't agree")
        return out


def certify(before: DataFrame, after: DataFrame, key: str, fields: list[str], journal: list[DataFrame]) -> tuple[DataFrame, Proof]:
    """(surfaces, proof): each claim about a run checked anew from the table before, the table after and the journal of
    patches.  surfaces: (surface, ok).

    input: the keys are the same.  replay: the journal, applied in order, gives the table after.  inverse: undone, the table
    before.  untouched: what no patch names is as it was.  preconditions: every patch found its old value.  idempotent: no
    patch of the last step changes the table after."""
    spark, proof = before.sparkSession, Proof()
    same = lambda a, b: table_digest(a.select(*sorted(a.columns))).first() == table_digest(b.select(*sorted(a.columns))).first()
    first = proof.add_table("before", before)
    now, last, met = before, first, True
    for step, patches in enumerate(journal):
        told = patches.select(*CELL, "old_value", "new_value")
        here = now.select(F.col(key).alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("c")).select("row_id", "c.*")
        met &= told.join(here, CELL, "left").where("not v <=> old_value").isEmpty()
        now = rp.apply_patches(now, key, told, fields)
        last = proof.add_table(f"step {step}", told, last)
    end = proof.add_table("after", after, last)
    back = rp.replay_inverse(after, key, fields, journal)
    others = [c for c in before.columns if c not in fields]
    named = None
    for patches in journal:
        named = patches.select("row_id") if named is None else named.unionByName(patches.select("row_id"))
    rest = (lambda df: df if named is None else df.join(named.distinct(), F.col(key) == F.col("row_id"), "left_anti"))
    checks = {
        "input": same(before.select(key), after.select(key)), "replay": same(now, after), "inverse": same(back, before), "untouched": same(before.select(*others), after.select(*others)) and same(rest(before), rest(after)),
        "preconditions": met, "idempotent": not journal or same(rp.apply_patches(after, key, journal[-1], fields), after), "hashes": not proof.problems(),
    }
    proof.add("verdict", checks, first, end)
    return spark.createDataFrame(list(checks.items()), "surface string, ok boolean"), proof


def obligations(issues: DataFrame, candidates: DataFrame) -> DataFrame:
    """(obligation_id, kind, row_id, field, code, tokens): issues (row_id, field, code, tokens array) that no unique candidate
    settles: OPEN_AMBIGUOUS where several values are proposed, OPEN_UNREPAIRABLE where none is.  tokens name what might
    settle it: path:/a/b, relation:x, source:y."""
    values = candidates.groupBy(*CELL).agg(F.count_distinct("new_value").alias("values"))
    left = issues.join(values, CELL, "left").where("values is null or values <> 1")
    kind = F.when(F.col("values") > 1, "OPEN_AMBIGUOUS").otherwise("OPEN_UNREPAIRABLE")
    name = F.concat(F.lit("obl_"), F.substring(F.sha2(F.concat_ws("\x1f", kind, F.col("row_id").cast("string"), "field", "code"), 256), 1, 20))
    return left.select(name.alias("obligation_id"), kind.alias("kind"), "row_id", "field", "code", F.array_sort(F.array_distinct("tokens")).alias("tokens"))


def wake(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(woken, retained): obligations that a change (token) touches, with the changes, and all others, which stay open.  A
    path is touched by a change at it, above it or below it; other tokens by the same token, or by one that ends in * and
    begins alike; global:* touches all.

    Both sides send a path and those above it, so the join is by equality; obligations of one path meet a change, not each
    other."""
    whole = changes.where("token = 'global:*'").limit(1).select(F.lit("global:*").alias("hit"))
    is_path = F.col("token").startswith("path:")
    asked = registry.select("obligation_id", F.explode("tokens").alias("token"))
    up = lambda df, key: df.where(is_path).select(*key, F.explode(prefixes(F.substr("token", F.lit(6)))).alias("at"), "token")
    own = asked.where(is_path).select("obligation_id", F.substr("token", F.lit(6)).alias("at"))
    above = up(changes, []).select("at", F.col("token").alias("hit")).join(own, "at").select("obligation_id", "hit")
    below = up(asked, ["obligation_id"]).select("obligation_id", "at").join(changes.where(is_path).select(F.substr("token", F.lit(6)).alias("at"), F.col("token").alias("hit")), "at").select("obligation_id", "hit")
    plain = asked.where(~is_path).join(changes.where(~is_path & ~F.col("token").endswith("*")).select("token", F.col("token").alias("hit")), "token").select("obligation_id", "hit")
    stars = changes.where(F.col("token").endswith("*") & (F.col("token") != "global:*")).select(F.col("token").alias("hit"))
    wild = asked.join(F.broadcast(stars.limit(1000)), F.expr("startswith(token, substr(hit, 1, length(hit) - 1))")).select("obligation_id", "hit")  # patterns that a caller writes
    every = registry.select("obligation_id").join(F.broadcast(whole))
    hits = above.unionByName(below).unionByName(plain).unionByName(wild).unionByName(every).groupBy("obligation_id").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    return registry.join(hits, "obligation_id"), registry.join(hits.select("obligation_id"), "obligation_id", "left_anti")


def save_obligations(registry: DataFrame, folder: str) -> None:
    """The registry with its digest, published as a whole."""
    from ..sources import write_report

    write_report({"obligations": registry, "digest": table_digest(registry)}, folder)


def load_obligations(spark, folder: str) -> DataFrame:
    """A saved registry; ValueError if it doesn't agree with its digest."""
    registry = spark.read.parquet(f"{folder}/obligations")
    if table_digest(registry).first() != spark.read.parquet(f"{folder}/digest").first():
        raise ValueError("the registry has been changed")
    return registry


def typed_form(df: DataFrame, key: str, fields: list[str], relations: DataFrame, issues: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, constraints, terminals) of an analysis, each truth one of TRUE, FALSE, UNKNOWN.

    nodes: (row_id, field, kind, digest) of every cell.  constraints: relations (relation_id, kind, inputs, output) with
    whether the table satisfies them and by how many issues (relation_id, row_id, field, code) it doesn't.  terminals: each
    issue, false as the table stands, with whether one value is known that would mend it."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "date": "string", "timestamp": "string"}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNull(), "null").otherwise(F.lit(kinds.get(df.schema[f].dataType.simpleString(), "integer" if df.schema[f].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") else "number"))).alias("kind"), F.sha2(F.coalesce(F.col(f).cast("string"), F.lit("null")), 256).alias("digest")) for f in fields))
    nodes = df.select(F.col(key).alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*")
    broken = issues.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"))
    constraints = relations.join(broken, "relation_id", "left").select(*relations.columns, F.when(F.col("n").isNull(), "TRUE").otherwise("FALSE").alias("satisfied"), F.coalesce("n", F.lit(0).cast("long")).alias("violations"))
    known = candidates.groupBy(*CELL).agg(F.count_distinct("new_value").alias("values"))
    terminals = issues.select("relation_id", *CELL, "code").join(known, CELL, "left")
    terminals = terminals.select("relation_id", *CELL, "code", F.lit("FALSE").alias("satisfied"), F.when(F.col("values") == 1, "TRUE").otherwise("UNKNOWN").alias("reconstruction"))
    return nodes, constraints, terminals


def manifest(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(path, digest) of every cell, path being /key/field."""
    cells = F.array(*(F.struct(F.concat(F.lit("/"), F.col(key).cast("string"), F.lit(f"/{f}")).alias("path"), F.sha2(F.coalesce(F.col(f).cast("string"), F.lit("\x00")), 256).alias("digest")) for f in fields))
    return df.select(F.explode(cells).alias("c")).select("c.*")


def divergent(runs: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(path, inputs, outputs): runs as (manifest of the input, manifest of the output).  A path whose input is the same in two
    runs must have the same output: those that haven't, with how many different outputs there are."""
    told = None
    for before, after in runs:
        one = before.select("path", F.col("digest").alias("i")).join(after.select("path", F.col("digest").alias("o")), "path", "full_outer")
        told = one if told is None else told.unionByName(one)
    by_input = told.groupBy("path", "i").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("o", F.lit(""))).alias("outputs"))
    return by_input.where("outputs > 1").select("path", F.col("n").alias("runs"), "outputs")
