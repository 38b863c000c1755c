"""What holds however large a table is: which side of a join is sent to all executors, and what decides an order."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import metrics, models, text
from tessera.operators.batched import Linear
from tessera.operators.prefix import cumulative, medians
from tessera.operators.splits import expanding_folds
from tessera.sources.arrow import map_arrow
from tessera.sources.scratch import written


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_never_broadcast_for_medians_and_running_sums(spark):
    rows = written(spark.range(3000).select((F.col("id") % 3).alias("k"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("x")))
    each = rows.select("k", F.posexplode("x").alias("j", "v"))
    found = medians(each, ["k", "j"], "v")
    assert "BuildLeft" not in plan(found)
    assert "BuildLeft" not in plan(cumulative(rows.select("k", F.get("x", F.lit(0)).alias("s"), F.lit(1).alias("n")), ["k"], "s", {"upto": "n"}))
    want = {(k, j): (j + 1) * (k + 1498.5 if k < 3 else 0) for k in range(3) for j in range(2)}
    assert {(r.k, r.j): r["median"] for r in found.collect()} == want
    assert {(r.k, r.j): r["median"] for r in medians(each, ["k", "j"], "v", few=True).collect()} == want


def test_folds_are_joined_to_rows_without_broadcasts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(models, "written", lambda df: plans.append(plan(df)) or written(df))
    df = written(spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 4).cast("int").alias("year"), (F.col("id") % 7 * 1.0).alias("x")))
    outer = written(expanding_folds(df, "id", "year", [(3, 3)]))
    models.nested_validate(df, outer, lambda t: expanding_folds(t, "id", "year", [(2, 2)]), "id", "label", {"a": Linear(("x",)), "b": Linear(("x",), 0.1)}).collect()
    assert plans and not any("LeftSemi, Build" in p for p in plans)


def same(spark, tmp_path, name: str, tables: dict) -> bool:
    """Whether a registered query gives what its SQL does."""
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = __spark_entry__.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=repr)
    return got == want and bool(got)


def test_primary_result_with_part_keys_beyond_a_million(spark, tmp_path):
    lines = [(1, 1_000_501, 1), (1, 3, 2), (2, 7, 1), (2, 2_000_001, 1), (2, 5, 3), (3, 1_100_000, 2), (3, 1_000_001, 1)]
    rows = [(o, p, n, 1.0 * n + i, 0.01 * i, "A") for i, (o, p, n) in enumerate(lines)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string")
    assert same(spark, tmp_path, "primary_result", {"lineitem": lineitem})


def test_vector_concat_with_vectors_beyond_a_hundred_thousand(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [0.25 * (i % 7) + 0.5 * j for j in range(64)]) for i in (0, 1, 2, 100_001, 100_003)], "vec_id long, embedding array<float>")
    assert same(spark, tmp_path, "vector_concat", {"documents": spark.range(5).withColumnRenamed("id", "doc_id"), "embeddings": vectors})


def test_metrics_read_their_rows_once_and_agree_with_the_single_ones(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    score = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 70 == 1, float("nan")).otherwise(F.pmod(h, F.lit(300)) / 300.0)
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 40 != 7, (h < 300).cast("int")).alias("y"), score.alias("s"))
    found = metrics.metric_bundle(rows, "y", "s", ["g"])
    assert "Range" not in plan(found)
    got = {r.g: r for r in found.collect()}
    for name, df in (("roc_auc", metrics.roc_auc(rows, "y", "s", ["g"])), ("pr_auc", metrics.average_precision(rows, "y", "s", ["g"]))):
        assert {g: r[name] for g, r in got.items()} == {r[0]: round(r[1], 6) for r in df.collect()}


def test_term_weights_leave_a_task_in_small_batches(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(text, "map_arrow", lambda df, run, schema: runs.append(run) or map_arrow(df, run, schema))
    terms = text.Terms(("alpha", "beta"), (1.0, 2.0), ())
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "none")], "id long, t string")
    want = [(1, ["alpha", "beta"]), (2, []), (3, [])]
    out = text.term_weights(df, terms, "t").collect()
    number = text.term_weights(df.withColumn("n", F.lit(7)), terms, "n").collect()
    assert sorted((r.id, [x.term for x in r.weights]) for r in out) == want and all(not r.weights for r in number)
    words = pa.array(["alpha beta"] * 600)
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(600)), words], names=["id", "t"]), words], ["_row", "_text"])
    found = list(runs[0](iter([batch])))
    assert sum(b.num_rows for b in found) == 600 and max(b.num_rows for b in found) <= 256
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(600)) and all(len(x) == 2 for b in found for x in b.column(2).to_pylist())
