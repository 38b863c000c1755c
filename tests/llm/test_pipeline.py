import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from tests_support import corpus


def test_stages_keep_their_promises(spark, tmp_path):
    docs, bench = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, [{r[0] for r in now.select("doc_id").collect()}]
    for k, (_, step) in enumerate(P.STAGES):
        now = step(spark, now, folder)
        if k < len(P.STAGES) - 1:
            assert now.columns == columns
        now = now.cache()
        seen.append({r[0] for r in now.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    assert {r[0] for r in P.run(spark, folder).select("doc_id").collect()} == seen[-1]
    gone = [a - b for a, b in zip(seen, seen[1:], strict=False)]
    text = {d[0]: d[1] or "" for d in docs}
    assert gone[0] == {i for i, t in text.items() if not re.search(r"[^\W\d_]", t)}
    assert gone[1] == {301} and gone[2] == {302} and gone[3] == {303} and gone[4] == set()


def test_stages_pass_other_columns_on(spark, tmp_path):
    docs, bench = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    plain = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain
    for name in ("score", "lang_pred", "held_out", "id", "_id", "_all_text", "row", "kept", "d", "k", "a.b", "n_hit", "size"):
        more = more.withColumn(name, F.concat(F.lit(name), F.lit(" of "), F.col("doc_id").cast("string")))
    now = more
    for _, step in P.STAGES[:-1]:
        now = step(spark, now, folder)
        assert now.columns == more.columns
        now = now.cache()
    assert all(r["score"] == f"score of {r['doc_id']}" and r["lang_pred"] == f"lang_pred of {r['doc_id']}" for r in now.collect())
    mixed = {tuple(r) for r in P.mixed(spark, now, folder).collect()}
    left = plain.join(now.select("doc_id"), "doc_id", "left_semi").select(plain.columns)
    assert mixed == {tuple(r) for r in P.mixed(spark, left, folder).collect()} and len(mixed) > 50


def test_decisions_go_with_rows_and_not_with_ids(spark, tmp_path):
    docs, bench = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    text = {d[0]: d[1] for d in docs}
    clean, base = text[20], text[10]
    near, leak = text[12], text[303]
    rows = [(10, base), (10, base), (10, base), (12, near), (None, clean), (None, base.replace(" ", "  ")), (None, near + " tail"), (None, leak), (40, leak.replace(" ", "\n")), (12, text[30]), (12, near + " end"), (None, text[32]), (None, text[32])]
    now = spark.createDataFrame([(i, t, "aa", "s1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {
        "exact_dedup": [(10, base), (12, near), (None, clean), (None, near + " tail"), (40, leak.replace(" ", "\n")), (12, text[30]), (12, near + " end"), (None, text[32])],
        "decontamination": [(10, base), (None, clean), (12, text[30]), (None, text[32])],
    }
    for name, step in P.STAGES[1:4]:
        now = step(spark, now, folder).cache()
        got = sorted(((r.doc_id, r.text) for r in now.collect()), key=repr)
        if name in want:
            left = sorted(want[name], key=repr)
            assert [x for x in got if near not in x[1]] == [x for x in left if near not in x[1]]
        assert sum(near in t for _, t in got) == (3 if name == "exact_dedup" else 1)
    assert all(i == 12 for i, t in got if near in t)
    whole = P.one_of_near(spark, spark.createDataFrame([(1, base), (1, base), (None, base), (None, clean), (None, clean)], "doc_id long, text string"), folder)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted([(1, base), (None, clean)], key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_empty_tables(spark, tmp_path):
    docs, bench = corpus()
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(docs[:20], SCHEMA)
    for name, step in P.STAGES:
        out = step(spark, empty, folder)
        assert out.collect() == [] and (name == "mixing" or out.columns == some.columns)
    assert P.without_benchmark(spark, some, folder).count() == 20
    unlabelled = some.withColumn("lang", F.lit(None).cast("string"))
    assert P.known_language(spark, unlabelled, folder).collect() == []
    empty.write.parquet(f"{folder}/documents.parquet")
    assert P.run(spark, folder).collect() == []


def test_stages_of_nulls_ties_and_long_texts(spark, tmp_path):
    docs, bench = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = " ".join(f"{w}{k % 977}" for k, w in enumerate((docs[20][1] + " ").split() * 6000))  # over 2 MB
    assert len(long) > 1 << 21
    tail = long + " " + bench[0][1]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (5, "", None, None, 0), (400, long, "aa", "s1", None), (400, long, "aa", "s1", None), (401, long + " more", None, None, None), (402, tail, "aa", None, None), (None, "der und schön", None, None, None)]
    now = spark.createDataFrame([*docs, *odd], SCHEMA).repartition(4)
    stays = {}
    for name, step in P.STAGES[1:4]:
        now = step(spark, now, folder).cache()
        stays[name] = [(r.doc_id, len(r.text or "")) for r in now.collect()]
    assert sum(not n for _, n in stays["exact_dedup"]) == 1 and (5, 0) in stays["exact_dedup"]
    assert [i for i, n in stays["exact_dedup"] if n > 1 << 21] .count(400) == 1
    near = sorted((i, n) for i, n in stays["near_dedup"] if n > 1 << 21)
    assert near == [(400, len(long))]
    assert (400, len(long)) in stays["decontamination"] and (None, 13) in stays["decontamination"] and (5, 0) in stays["decontamination"]
    leaks = spark.createDataFrame([(402, tail), (1, tail), (2, None), (None, long)], "doc_id long, text string")
    assert sorted(len(r.text or "") for r in P.without_benchmark(spark, leaks, folder).collect()) == [0, len(long)]
    mixed = P.mixed(spark, now, folder).collect()
    assert len(mixed) == now.count() and next(r for r in mixed if r.doc_id == 5).taken == 0
    judged = P.known_language(spark, spark.createDataFrame([*docs, (400, long, None, None, None), (400, long, None, None, None)], SCHEMA), folder)
    assert judged.filter("doc_id = 400").count() == 2
