"""What holds a task's work within bounds as tables grow."""

import re
from decimal import Decimal

from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline.operators import aggregates as agg
from plumbline.operators import conflicts as cf
from plumbline.operators import references as ref
from plumbline.plans import catalog, streams
from plumbline.sources.shared import ROWS, dealt, tasks
from plumbline.streaming import batches

SF = "/root/testdata/sf0.01"


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_by_their_number(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks(spark, n) for n in (0, 1, 4_000, 10 * ROWS, 10 * ROWS + 1)] == [1, 1, min(cores, 2), max(cores, 10), max(cores, 11)]
    assert tasks(spark, 10**6, rounds=3) == 3 * cores
    df = dealt(spark.range(50_000).coalesce(1), "id")
    assert df.rdd.getNumPartitions() == cores and df.count() == 50_000


def test_a_scan_of_one_task_is_dealt_before_documents_are_parsed(spark):
    for name in ("graph_discover", "schema_ref", "schema_patternProperties", "scan_tree_walk", "scan_leaf_paths"):
        assert "RepartitionByExpression" in plan(catalog.QUERIES[name](spark, SF)), name


def test_files_of_a_stream_are_dealt_by_their_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    folder, schema, files = streams._landed(spark, spark.range(60_000))
    landed = spark.read.schema(schema).parquet(folder)
    assert len(landed.inputFiles()) == streams.PARTS * cores and files == cores and landed.count() == 60_000
    folder, schema, files = streams._landed(spark, spark.range(60), spark.range(7 * ROWS).select("id"))
    assert len(spark.read.schema(schema).parquet(folder).inputFiles()) <= max(7, streams.PARTS * cores) and files == max(1, min(cores, max(7, streams.PARTS * cores) // streams.PARTS))
    folder, _, files = streams._landed(spark, spark.range(60))
    assert files == 1 and len(spark.read.parquet(folder).inputFiles()) == streams.PARTS


def test_batches_of_several_files_add_up(spark):
    rows = spark.range(30_000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("d"), (F.col("id") % 7 % 3).cast("string").alias("v"))
    got = batches.functional(rows, spark).collect()
    assert {r["d"]: (r["mode"], r["n"]) for r in got} == {str(i): (str(i % 3), len(range(i, 30_000, 7))) for i in range(7)}


def test_plain_numbers_are_exact_without_a_look_at_their_digits(spark):
    texts = ["17", "-0.5", "+3.140000000", " 8 ", "9\n", "1" * 28, "1" * 29, "1" * 30, "0.123456789", "0.1234567891", "0.1234567890", "1e3", "12e-10", ".5", "5.", "", ".", "-", "1 2", "0x1", "NaN", "1d", None]
    want = ["17", "-0.5", "3.14", "8", "9", "1" * 28, "1" * 29, None, "0.123456789", None, "0.123456789", "1000", None, "0.5", "5", None, None, None, None, None, None, None, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", fn.exact("t").alias("x"))
    assert [r["x"] for r in df.orderBy("i").collect()] == [None if w is None else Decimal(w) for w in want]
    assert "RLIKE" in plan(df)
    numbers = spark.createDataFrame([(17.0,), (-0.0,), (1e7,), (9007199254740993.0,), (0.05,), (0.1 + 0.2,), (1e300,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(fn.exact("x")).collect()] == [Decimal(17), Decimal(0), Decimal(10**7), Decimal(9007199254740992), Decimal("0.05"), None, None, None, None]


def test_products_of_whole_numbers_are_short_unless_they_overflow(spark):
    big = 10**10
    kids = spark.createDataFrame([(p, big + p, i) for p in range(6) for i in (1, 2)], "p long, size long, line int")
    parents = spark.createDataFrame([(p, Decimal(big + p), Decimal(0)) for p in range(6)], "p long, avg_size decimal(38,0), var_size decimal(38,0)")
    df = agg.inferred_moments(parents, "p", ["avg_size", "var_size"], kids, "p", ["size", "line"])
    assert ("mean", "avg_size", "size", None, 6) in [(r["kind"], r["output"], r["value"], r["weight"], r["support"]) for r in df.collect()]
    assert ("weighted_mean", "avg_size", "size", "line", 6) in [(r["kind"], r["output"], r["value"], r["weight"], r["support"]) for r in df.collect()]
    assert re.search(r"size#\d+L( \*|,) size#\d+L", plan(df))


def test_residue_is_that_of_a_full_outer_join_without_a_sort(spark):
    left = spark.createDataFrame([(1, "a", 5), (1, "a", 2), (1, "b", None), (2, None, 4), (None, "a", 1), (3, "c", 1), (4, "d", 0)], "g long, k string, q int")
    right = spark.createDataFrame([(1, "a", 7), (1, "b", 3), (2, None, 4), (None, "a", 1), (5, "e", 9), (6, "f", 0)], "g long, k string, q long")
    total = lambda df, n: df.groupBy("g", "k").agg(F.sum("q").alias(n))
    want = total(left, "left_quantity").join(total(right, "right_quantity"), ["g", "k"], "full_outer").na.fill(0, ["left_quantity", "right_quantity"])
    want = want.withColumn("difference", F.col("left_quantity") - F.col("right_quantity")).where("difference <> 0")
    got = ref.residue(left, right, "g", "k", "q")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    long = spark.range(2 * ROWS).select(F.col("id").alias("g"), (F.col("id") % 3).cast("string").alias("k"), F.lit(1).alias("q"))
    assert re.search(rf"RepartitionByExpression \[g#\d+L?, k#\d+\], {max(4, spark.sparkContext.defaultParallelism)}\b", plan(ref.residue(long, long, "g", "k", "q")))


def test_lists_without_keys_are_never_the_same(spark):
    rows = [(g, f"k{g % 3}", g, 1) for g in range(40)]
    left = spark.createDataFrame([*rows, (None, "z", 1, 1)], "g long, k string, q long, m int")
    right = spark.createDataFrame([*rows, (None, "z", 1, 1)], "g long, k string, q long, m int")
    df = agg.multisets(left, right, "g", [("k", "q"), ("k", "m")])
    assert sorted((r["key"], r["quantity"], r["support"], r["decided"]) for r in df.collect()) == [("k", "m", 40, 41), ("k", "q", 40, 41)]
    assert "Join" not in plan(df) and "RepartitionByExpression" in plan(df)


def test_equal_members_are_told_by_place(spark):
    long = "m" * 70
    members = [(1, "/a", 1, "x"), (1, "/a", 2, "x"), (1, "/a", 3, "y"), (1, "/b", 1, long), (1, "/b", 2, long), (1, "/b", 2, "x"), (2, "/a", 1, "x"), (2, "/a", 1, "x"), (3, "/a", 1, None), (3, "/a", 2, None), (None, "/a", 1, "x"), (None, "/a", 2, "x"), (4, "/a", None, "x"), (4, "/a", 2, "x")]
    options = [(r, p, at, o) for r in (1, 2, 3, None, 4) for p in ("/a", "/b") for at, o in ((1, "o1"), (2, "o2"), (2, "o3"), (3, "o4"), (None, "o5"))]
    df = cf.symmetric(spark.createDataFrame(options, "row_id long, array_path string, position int, option_id string"), spark.createDataFrame(members, "row_id long, array_path string, position int, member string"))
    found = {}
    for r, p, at, m in members:
        for r2, p2, at2, o in options:
            if (r, p, at) == (r2, p2, at2) and None not in (r, at):
                found.setdefault((r, p, m), []).append((at, o))
    want = {}
    for (r, p, _), hits in found.items():
        if len({at for at, _ in hits}) > 1 and len({o for _, o in hits}) > 1:
            want[r, p] = want.get((r, p), 0) + len({o for _, o in hits})
    assert {(r["row_id"], r["array_path"]): r["options"] for r in df.collect()} == want and len(want) == 3
    constant = spark.range(4 * ROWS).select(F.col("id").alias("row_id"), F.lit("/l").alias("array_path"), F.lit(1).alias("position"), F.lit("x").alias("member"))
    assert len(re.findall(rf"RepartitionByExpression .*, {max(4, spark.sparkContext.defaultParallelism)}\b", plan(cf.symmetric(constant.withColumnRenamed("member", "option_id"), constant)))) == 3
