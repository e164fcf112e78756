"""The pipeline: each stage's rows against the brute-force versions, and its columns."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import brute_exact, brute_near, brute_substring
from test_text import check_packing


def test_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = rows(docs), stage(spark, docs, sf).cache()
        if name != "packing":
            assert out.columns == columns
            after = rows(out)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = [labels[i] for i in after if i in labels]
            assert sum(kept) / len(kept) > 0.95 and sum(kept) / sum(labels.values()) > 0.95
        elif name == "exact":
            assert set(after) == {i for i, _, _, kept, _ in brute_exact(list(before.items())) if kept}
        elif name == "near":
            assert set(after) == {i for i, c in brute_near(list(before.items())).items() if i == c}
        elif name == "substring":
            want = {i: (n, gone) for i, n, gone, _ in brute_substring(list(before.items()))}
            assert set(after) == {i for i, (n, gone) in want.items() if not n or gone < n}
            assert all(len(after[i].split()) == want[i][0] - want[i][1] for i in after)
            assert all(after[i] == before[i] for i in after if not want[i][1])
        else:
            check_packing(out.collect(), {i: len(t.encode().split()) for i, t in before.items()})
        docs = out


def test_run_and_odd_rows(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "doc_id" in out.columns
    for t in ("labels",):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    base = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").withColumn("score", F.lit(1).cast("int"))
    base = spark.createDataFrame(base.collect(), base.schema.simpleString()[7:-1].replace(":", " "))
    odd = spark.createDataFrame([(None, None, None, None, None, None), (7, None, "en", "s", 0, 1), (900, "", None, None, None, None), (901, "word " * 200_000, "en", "s", 1, 1)], base.schema)
    base.unionAll(odd).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    base.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
