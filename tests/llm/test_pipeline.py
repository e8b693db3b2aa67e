"""The pipeline's stages, each against a plain version of it, and the whole of it."""

import corpus_pipeline as pipeline
from lintlake.llm import decontaminate, quality, secret_links
from lintlake.llm.common import table


def test_stages_and_run(spark, folder):
    docs = table(spark, folder, "documents")
    columns, now = docs.columns, docs
    seen = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, now, folder).cache()
        assert after.columns == columns
        seen[name] = (now.collect(), after.collect())
        now = after
    before, after = seen["quality"]
    scores = {r["doc_id"]: r["predicted"] for r in quality.classified(docs, table(spark, folder, "labels")).collect()}
    assert {r["doc_id"] for r in after} == {k for k, v in scores.items() if v == 1}
    from tests.llm.test_pairs import brute_classes
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after} == set(brute_classes({r["doc_id"]: r["text"] for r in before}).values())
    before, after = seen["decontaminate"]
    leaked = {r["doc_id"] for r in decontaminate.report(spark.createDataFrame(before, docs.schema), table(spark, folder, "benchmark")).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaked
    before, after = seen["secrets"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
    assert not any(secret_links.parts(r["text"] or "") and any(p[0] in secret_links.BASE for p in secret_links.parts(r["text"])) for r in after)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] or secret_links.parts(texts[r["doc_id"]]) for r in after)
    before, after = seen["mix"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and 0 < len(after) < len(before)
    assert sorted(r["doc_id"] for r in pipeline.run(spark, folder).collect()) == sorted(r["doc_id"] for r in after)


def test_quality_keeps_all_without_a_classifier(spark):
    docs = spark.createDataFrame([(k, f"plain words number {k}", 20) for k in range(30)] + [(None, None, None)], "doc_id long, text string, n_chars long")
    for labels in ([], [(k, None) for k in range(30)], [(None, 1)], [(k, 0) for k in range(30)]):
        made = quality.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert made.columns == docs.columns and sorted(map(str, made.collect())) == sorted(map(str, docs.collect()))


def test_stages_carry_columns_of_any_name(spark, folder):
    """Names with dots and quotes, and those of the operators' helpers: the same documents stay, with their columns."""
    from pyspark.sql import functions as F
    docs = table(spark, folder, "documents").limit(60)
    docs = docs.unionByName(docs.limit(20)).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("text"), F.lit("\npassword=abcdef1"))).otherwise(F.col("text")))
    extra = ["a.b", "c`d", "__leak", "_doc", "_c", "_u", "bands", "node", "n_hit", "_spans", "label", "weight", "carried_6"]
    wide = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(name) for k, name in enumerate(extra)])
    for _, stage in pipeline.STAGES:
        made, plain = stage(spark, wide, folder), stage(spark, docs, folder)
        assert made.columns == wide.columns
        rows = [tuple(r) for r in made.collect()]
        width = len(docs.columns)
        assert sorted(map(repr, (r[:width] for r in rows))) == sorted(map(repr, map(tuple, plain.collect())))
        assert all(r[width:] == tuple(f"{k}:{r[0]}" for k in range(len(extra))) for r in rows)


def test_stages_on_odd_rows(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string"
    rows = [(1, None, "en", "a", 5, "q"), (1, None, "en", "a", 5, "q"), (None, "some words", None, None, None, "z"), (4, "", None, "b", 0, "w"), (5, "password=abcdef1 and words", None, "b", 0, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in pipeline.STAGES:
            made = stage(spark, docs, folder)
            assert made.columns == docs.columns
            left = [tuple(r) for r in made.collect()]
            assert len(left) <= len(given) and all(r[0] in {g[0] for g in given} and r[-1] in {g[-1] for g in given} for r in left)
