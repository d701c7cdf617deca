"""The pipeline's stages against brute force, on rows with null and repeated ids."""

from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string"


def words(name, n=80):
    return " ".join(f"{name}{k}x" for k in range(n))


ROWS = [(None, words("a"), "en"), (None, words("b"), "en"), (None, words("c", 9), "en"), (1, words("d"), "en"), (1, words("e"), "en"), (1, words("f", 9), "de"), (1, words("d"), "en"), (2, words("e") + " \n", "en"), (3, words("b"), "en"), (None, words("g"), "en"), (None, words("g"), "en")]


def test_stages_keep_rows_not_ids(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    spark.createDataFrame([(None, 1), (1, 1), (1, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    long = [r for r in ROWS if len(r[1].split()) >= 50]  # too few labels for any other rule
    judged = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert judged.columns == docs.columns and Counter(map(tuple, judged.collect())) == Counter(long)
    best = {}
    for r in long:
        key = "".join(r[1].split())
        best[key] = min(best.get(key, r), r, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
    first = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(long, SCHEMA), str(tmp_path))
    assert Counter(map(tuple, first.collect())) == Counter(best.values())
    # no two of these texts are alike, apart from the blank end and the repeats
    near = [*best.values(), (4, words("d") + " more", "en"), (1, words("d"), "en")]
    second = corpus_pipeline.near_dedup(spark, spark.createDataFrame(near, SCHEMA), str(tmp_path))
    assert Counter(map(tuple, second.collect())) == Counter(best.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == Counter(r[0] for r in best.values())


def test_stages_on_odd_columns_and_empty_tables(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, _row string, _digest int, kept string, `keep_id` double, _id string, best array<int>"
    rows = [(k, t, None, "r", None, "no", None, "i", [k]) for k, t in enumerate([None, "", words("a"), words("a"), words("b", 9000), words("c") + " tail"])] + [(None, words("d"), "en", None, 1, None, 0.5, None, None)]
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    judged = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert judged.schema == docs.schema and Counter(map(str, judged.collect())) == Counter(str(r) for r in docs.collect() if r.text)
    first = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {(r.doc_id, r._row, r.best and r.best[0]) for r in first.collect()} == {(0, "r", 0), (2, "r", 2), (4, "r", 4), (5, "r", 5), (None, None, None)}
    second = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert second.columns == docs.columns and {(r.doc_id, r._digest, r._id) for r in second.collect()} == {(0, None, "i"), (1, None, "i"), (2, None, "i"), (4, None, "i"), (5, None, "i"), (None, 1, None)}
    nothing = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, str(tmp_path))
        assert out.collect() == [] and (name == "packing" or out.columns == nothing.columns)


def test_of_rows_that_repeat_id_and_text_the_same_one_stays(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, more map<string,int>"
    rows = [(k % 2 or None, words("z") if k < 20 else words("y"), f"l{k:02}", {"k": k}) for k in range(40)]
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        got = [sorted((r.text[0], r.lang) for r in stage(spark, spark.createDataFrame(rows[::step], kind).repartition(n), str(tmp_path)).where("doc_id = 1").collect()) for step, n in ((1, 2), (-1, 5))]
        assert got[0] == got[1] == [("y", "l39"), ("z", "l19")]
