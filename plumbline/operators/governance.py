"""Who may change what: authority scopes with delegation, control, robustness, verified rules, actors and their packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, glob_regex, minus
from .conflicts import closure, prefixes
from .repair import CELL

#: Most delegations in a row.
MOST_HOPS = 17


def _scope_reason(scope: str) -> Column:
    """Why a request is out of a scope; null if it is inside."""
    s = lambda c: F.col(f"{scope}.{c}")
    r = lambda c: F.col(f"r.{c}")
    free = lambda c: (s(c) == "*") | s(c).eqNullSafe(r(c))
    return (
        F.when(~F.rlike(r("path"), s("path_regex")), "PATH_OUT_OF_SCOPE").when(~((s("operation") == "*") | (s("operation") == r("operation"))), "OPERATION_OUT_OF_SCOPE")
        .when(~free("document"), "DOCUMENT_OUT_OF_SCOPE").when(~free("version"), "SCHEMA_VERSION_OUT_OF_SCOPE")
        .when((s("valid_from").isNotNull() | s("valid_until").isNotNull()) & r("at").isNull(), "TEMPORAL_SCOPE_REQUIRES_EVALUATION_TIME")
        .when(r("at") < s("valid_from"), "AUTHORITY_NOT_YET_VALID").when(r("at") > s("valid_until"), "AUTHORITY_EXPIRED")
    )


#: Of several scopes the one that a request comes nearest to tells why it is refused.
_NEAREST = ("AUTHORITY_EXPIRED", "AUTHORITY_NOT_YET_VALID", "TEMPORAL_SCOPE_REQUIRES_EVALUATION_TIME", "SCHEMA_VERSION_OUT_OF_SCOPE", "DOCUMENT_OUT_OF_SCOPE", "OPERATION_OUT_OF_SCOPE", "PATH_OUT_OF_SCOPE", "NO_DIRECT_AUTHORITY")


def authorise(requests: DataFrame, scopes: DataFrame, delegations: DataFrame, checkpoint, hops: int = MOST_HOPS) -> DataFrame:
    """(request_id, authorised, reason, chain): whether a source may do an operation on a path of a document of a schema
    version at a time.  requests: (request_id, source_id, path, operation, document, version, at).  scopes: (source_id,
    path_glob, operation, document, version, valid_from, valid_until), * for any.  delegations: (delegation_id, grantor,
    delegate, revoked) and the columns of a scope: what a grantor who is authorised passes on.

    A request is followed from its source over delegations that cover it, a hop a step, until somebody is authorised
    directly; nobody is asked twice on a way, and longer ways than ``hops`` are refused.  Scopes and delegations are declared
    by people and are broadcast."""
    with_regex = lambda df: df.join(F.broadcast(_regexes(df)), "path_glob")
    own, passed = F.broadcast(with_regex(scopes)).alias("s"), F.broadcast(with_regex(delegations.where("not revoked"))).alias("d")
    rank = lambda c: reduce(lambda a, x: F.when(c == x[1], F.lit(x[0])).otherwise(a), enumerate(_NEAREST), F.lit(len(_NEAREST)))

    def direct(asked: DataFrame) -> DataFrame:
        """asked with ``reason``: null where its holder is authorised directly."""
        tried = asked.alias("r").join(own, F.col("r.holder") == F.col("s.source_id"), "left").select("r.*", F.when(F.col("s.source_id").isNull(), "NO_DIRECT_AUTHORITY").otherwise(_scope_reason("s")).alias("why"))
        best = tried.groupBy(*asked.columns).agg(F.min(F.struct(F.when(F.col("why").isNull(), -1).otherwise(rank(F.col("why"))).alias("rank"), "why")).alias("w"))
        return best.select(*asked.columns, F.col("w.why").alias("reason"))

    asked = requests.withColumns({"holder": F.col("source_id"), "chain": F.array().cast("array<string>")})
    tried = checkpoint(direct(asked), "direct")
    done = tried.where("reason is null").select("request_id", F.lit(True).alias("authorised"), F.lit("DIRECT_SCOPE_MATCH").alias("reason"), "chain")
    refused = tried.where("reason is not null")
    left = refused.drop("reason")
    for hop in range(hops):
        on = left.alias("r").join(passed, F.col("r.holder") == F.col("d.delegate")).where(_scope_reason("d").isNull() & ~F.array_contains(F.col("r.chain"), F.col("d.delegation_id")) & (F.col("d.grantor") != F.col("r.source_id")))
        moved = on.select(*(F.col(f"r.{c}") for c in requests.columns), F.col("d.grantor").alias("holder"), F.concat("r.chain", F.array("d.delegation_id")).alias("chain"))
        step = checkpoint(direct(moved), f"hop-{hop}")
        if step.isEmpty():
            break
        got = step.where("reason is null").groupBy("request_id").agg(F.min("chain").alias("chain"))
        done = done.unionByName(got.select("request_id", F.lit(True).alias("authorised"), F.lit("DELEGATED_SCOPE_MATCH").alias("reason"), "chain"))
        left = step.where("reason is not null").drop("reason").join(got.select("request_id"), "request_id", "left_anti")
    found = checkpoint(done, "done")
    none = refused.join(found.select("request_id"), "request_id", "left_anti").select("request_id", F.lit(False).alias("authorised"), "reason", "chain")
    return found.unionByName(none)


def _regexes(df: DataFrame) -> DataFrame:
    globs = [r[0] for r in df.select("path_glob").distinct().collect()]  # declared patterns
    return df.sparkSession.createDataFrame([(g, glob_regex(g)) for g in globs], "path_glob string, path_regex string")


def control(candidates: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(reachable, unreachable) under rules of precedence: each has ``path`` (a glob) and any of ``immutable``, ``operations``
    (allowed), ``denied``, ``permission`` (explicitly granted), ``budget`` (candidates of the rule's paths at most).  The rules
    that match a field are met together; one without permission where a rule asks for it is out of reach.  A budget keeps the
    candidates of the highest tier, then by row; more than it allows are out of reach, all that tie at its end included."""
    reason = F.lit(None).cast("string")
    operation = F.col("operation") if "operation" in candidates.columns else F.lit("replace")
    for rule in rules:
        here = F.col("field").rlike(glob_regex(rule["path"]))
        bad = F.lit(bool(rule.get("immutable", False)))
        if "operations" in rule:
            bad = bad | ~operation.isin(rule["operations"])
        if "denied" in rule:
            bad = bad | operation.isin(rule["denied"])
        if rule.get("permission") is False:
            bad = F.lit(True)
        why = "IMMUTABLE" if rule.get("immutable") else "OPERATION" if "operations" in rule or "denied" in rule else "PERMISSION"
        reason = F.coalesce(reason, F.when(here & bad, F.lit(why)))
    marked = candidates.withColumn("reason", reason)
    for rule in rules:
        if "budget" not in rule:
            continue
        here = F.col("field").rlike(glob_regex(rule["path"])) & F.col("reason").isNull()
        first = marked.where(here).select("tier", "row_id").orderBy(F.desc("tier"), "row_id").limit(rule["budget"] + 1).collect()
        if len(first) > rule["budget"]:
            end = first[-1]
            spent = (F.col("tier") < end["tier"]) | ((F.col("tier") == end["tier"]) & (F.col("row_id") >= end["row_id"]))
            marked = marked.withColumn("reason", F.when(here & spent, "BUDGET").otherwise(F.col("reason")))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(*CELL, F.lit("IDENTIFIABLE_BUT_UNREACHABLE").alias("code"), "reason")


def precedence(order: list[tuple[str, str]]) -> list[str] | None:
    """An order of rules that respects (first, then) pairs; None if they go round in a circle."""
    from graphlib import CycleError, TopologicalSorter

    needs: dict[str, set[str]] = {}
    for first, then in sorted(order):
        needs.setdefault(then, set()).add(first)
        needs.setdefault(first, set())
    try:
        return list(TopologicalSorter({k: sorted(v) for k, v in sorted(needs.items())}).static_order())
    except CycleError:
        return None


def robust(candidates: DataFrame, rules: DataFrame, now: Column, regime: Column | None = None) -> DataFrame:
    """Candidates with ``gate``: PASS, or the first gate that stops them.  rules: (field, radius, observed_at, max_age, regime,
    hysteresis), any null.  A number must move by more than its uncertainty (WITHIN_UNCERTAINTY) and by more than the
    hysteresis beyond it (WITHIN_HYSTERESIS); the rule's clock must be fresh (STALE); its regime must be the row's
    (OTHER_REGIME)."""
    joined = candidates.join(F.broadcast(rules), "field", "left")  # a row for each field
    moved = F.abs(minus(exact("new_value"), exact("old_value")))
    age = F.unix_seconds(now) - F.unix_seconds("observed_at")
    own = F.lit(None).cast("string") if regime is None else regime
    gate = (
        F.when(age > F.col("max_age"), "STALE").when(F.col("regime").isNotNull() & ~F.col("regime").eqNullSafe(own), "OTHER_REGIME")
        .when(moved <= F.col("radius"), "WITHIN_UNCERTAINTY").when(moved <= F.col("radius") + F.col("hysteresis"), "WITHIN_HYSTERESIS").otherwise("PASS")
    )
    return joined.withColumn("gate", gate).select(*candidates.columns, "gate")


#: Provenance of a rule, from the strongest to none.
PROVENANCE = ("SOURCE_EXACT", "DERIVED_EXACT", "USER_DECLARED", "INFERRED", "UNVERIFIED")


def verified_rules(rules: DataFrame, sources: DataFrame, parents: DataFrame, checkpoint) -> DataFrame:
    """rules (rule_id, text, claim, source_id) with ``provenance`` and ``active``.  A rule is SOURCE_EXACT if the source that it
    names has exactly its text, DERIVED_EXACT if all rules that it comes from (parents: rule_id, parent_id), to any depth, are
    SOURCE_EXACT, USER_DECLARED or INFERRED as claimed, else UNVERIFIED.  Unverified rules take no part in an analysis."""
    own = rules.join(F.broadcast(sources.select("source_id", F.sha2("text", 256).alias("digest"))), "source_id", "left")  # sources are documents that people declare
    exact_ = own.withColumn("exact", F.coalesce(F.col("digest") == F.sha2(F.col("text"), 256), F.lit(False))).select("rule_id", "exact", "claim")
    up = closure(parents.select(F.col("rule_id").alias("src"), F.col("parent_id").alias("dst")), checkpoint)
    leaves = up.join(parents.select(F.col("rule_id").alias("dst")).distinct(), "dst", "left_anti")
    derived = leaves.join(exact_.select(F.col("rule_id").alias("dst"), "exact"), "dst", "left").groupBy(F.col("src").alias("rule_id")).agg(F.bool_and(F.coalesce("exact", F.lit(False))).alias("derived"))
    status = (
        F.when(F.col("exact"), "SOURCE_EXACT").when((F.col("claim") == "DERIVED_EXACT") & F.coalesce("derived", F.lit(False)), "DERIVED_EXACT")
        .when(F.col("claim").isin("USER_DECLARED", "INFERRED"), F.col("claim")).otherwise("UNVERIFIED")
    )
    return rules.join(exact_.drop("claim"), "rule_id").join(derived, "rule_id", "left").withColumn("provenance", status).withColumn("active", F.col("provenance") != "UNVERIFIED").drop("exact", "derived")


def packets(candidates: DataFrame) -> DataFrame:
    """(actor, proposals, cells, digest): what each analyzer hands over; the digest doesn't depend on the order of rows."""
    row = F.sha2(F.concat_ws("\x1f", F.col("row_id").cast("string"), "field", "new_value"), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return candidates.groupBy(F.col("analyzer").alias("actor")).agg(F.count(F.lit(1)).alias("proposals"), F.count_distinct("row_id", "field").alias("cells"), F.sum(part).cast("decimal(38,0)").alias("digest"))


def federate(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consensus, conflicts): cells on whose value two actors or more agree and nobody differs, and cells on which actors
    differ, with what each says."""
    by_value = candidates.groupBy(*CELL, "new_value").agg(F.array_sort(F.collect_set("analyzer")).alias("actors"))
    by_cell = by_value.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("new_value", "actors"))).alias("says"), F.count(F.lit(1)).alias("values"))
    one = by_cell.where("values = 1").select(*CELL, F.col("says")[0]["new_value"].alias("new_value"), F.col("says")[0]["actors"].alias("actors")).where("size(actors) > 1")
    return one, by_cell.where("values > 1").select(*CELL, "says")


def active_pairs(candidates: DataFrame) -> DataFrame:
    """(first, second, cells, agree): pairs of actors that speak of the same cells, how many those are, and on how many they
    agree.  A cell has one value of each actor, so its pairs are those of the actors."""
    one = candidates.groupBy(*CELL, "analyzer").agg(F.min("new_value").alias("v"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.analyzer") < F.col("b.analyzer")))
    return met.groupBy(F.col("a.analyzer").alias("first"), F.col("b.analyzer").alias("second")).agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("a.v") == F.col("b.v"), 1)).alias("agree"))


def compose(relations: DataFrame, checkpoint) -> DataFrame:
    """(src, dst): directed relations that follow from given ones (src, dst) and aren't among them."""
    given = relations.select("src", "dst").distinct()
    return closure(given, checkpoint).join(given, ["src", "dst"], "left_anti").where("src <> dst")


def select_with_evidence(candidates: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(selected, deferred): a cell's value if all its candidates agree on it and at least so many analyzers, or an
    authoritative one, stand behind it.  Deferred, with the reason: cells without (EVIDENCE), with two values (AMBIGUOUS),
    of which one lies over another (OVERLAP), and, unless authoritative, of rows in which several fields would change
    (SEVERAL_FIELDS)."""
    cells = candidates.groupBy(*CELL).agg(F.min("old_value").alias("old_value"), F.min("new_value").alias("new_value"), F.count_distinct("new_value").alias("values"), F.count_distinct("analyzer").alias("analyzers"), F.max("tier").alias("tier"))
    over = cells.select("row_id", F.explode(F.slice(prefixes(F.col("field")), F.lit(1), F.size(F.split("field", "/")) - 1)).alias("field")).distinct()
    above = cells.join(over, CELL, "left_semi").select(*CELL)
    beneath = cells.select("row_id", F.col("field"), F.explode(prefixes(F.col("field"))).alias("up")).join(above.select("row_id", F.col("field").alias("up")), ["row_id", "up"]).select(*CELL)
    tangled = above.unionByName(beneath).distinct().withColumn("tangled", F.lit(True))
    many = cells.groupBy("row_id").agg(F.count(F.lit(1)).alias("fields"))
    judged = cells.join(tangled, CELL, "left").join(many, "row_id")
    reason = F.when(F.col("values") > 1, "AMBIGUOUS").when(F.col("tangled"), "OVERLAP").when((F.col("analyzers") < least) & (F.col("tier") < 3), "EVIDENCE").when((F.col("fields") > 1) & (F.col("tier") < 3), "SEVERAL_FIELDS")
    judged = judged.withColumn("reason", reason)
    return judged.where("reason is null").select(*CELL, "old_value", "new_value"), judged.where("reason is not null").select(*CELL, "reason")


def identify(issues: DataFrame, domains: DataFrame) -> DataFrame:
    """(row_id, field, status, solutions, witness): what the cells with an issue can be.  domains: (row_id, field, source,
    value), the values that a source (candidates, an enumeration, a registry) leaves open; a cell's solutions are those that
    every source of it admits.  INSUFFICIENT without any source; the witness is what would decide: a source, or so many
    bits as tell the solutions apart."""
    by_source = domains.groupBy(*CELL, "value").agg(F.count_distinct("source").alias("votes"))
    sources = domains.groupBy(*CELL).agg(F.count_distinct("source").alias("sources"))
    left = sources.join(by_source, CELL).groupBy(*CELL).agg(F.count(F.when(F.col("votes") == F.col("sources"), 1)).alias("solutions"))
    joined = issues.select(*CELL).distinct().join(left, CELL, "left")
    status = F.when(F.col("solutions").isNull(), "INSUFFICIENT").when(F.col("solutions") == 1, "UNIQUE").when(F.col("solutions") > 1, "MULTIPLE").otherwise("NONE")
    bits = F.length(F.bin(F.col("solutions") - 1)).cast("string")
    witness = F.when(status == "INSUFFICIENT", "any source").when(status == "MULTIPLE", F.concat(bits, F.lit(" bits"))).when(status == "NONE", "a withdrawn source")
    return joined.select(*CELL, status.alias("status"), F.coalesce("solutions", F.lit(0).cast("long")).alias("solutions"), witness.alias("witness"))
