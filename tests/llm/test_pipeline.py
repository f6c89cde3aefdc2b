import base64

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import nearcopies, quality, repeats, secret_scan, shared
from tests.llm import test_decontaminate, test_nearcopies, test_quality, test_secret_scan

SF = "/root/testdata/sf0.001"


def masked(text, spans):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], secret_scan.MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.judge(docs, model).collect()}
    stay = {d: t for d, t in texts.items() if not test_quality.base(t)[5] and score[d] >= 0.5}
    classes = test_nearcopies.brute(list(stay.items()))
    stay = {d: t for d, t in stay.items() if classes[d] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _ in test_decontaminate.brute(list(stay.items()), items)}
    stay = {d: t for d, t in stay.items() if d not in hit}
    spans = test_secret_scan.brute(list(stay.values()))
    stay = {d: masked(t, s) for (d, t), (_, s) in zip(stay.items(), spans, strict=True)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {d: library.encode_ordinary(t) for d, t in stay.items()}


def test_run_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    got, want = {r.doc_id: r.ids for r in rows}, brute(spark)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows) and len(got) == len(rows)
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_take_extra_columns_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = "*", "doc_id AS unit", "'x' AS bucket", "doc_id AS class_id", "map('a', 1) AS kind", "array(1.5) AS bands", "named_struct('v', 2) AS root", "current_date() AS words", "n_chars AS size", "'t' AS tokens"
    wide = docs.selectExpr(*extra)
    odd = wide.limit(4).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")})
    wide = wide.unionByName(wide.where("doc_id % 2 = 0")).unionByName(odd).unionByName(wide.limit(3).withColumn("text", F.lit(None).cast("string")))
    wide = shared.materialize(wide)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.materialize(stage(spark, wide, SF))
        assert out.dtypes == wide.dtypes and 0 < out.count() <= wide.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == wide.count()


def test_operators_take_a_smaller_id_type(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("doc_id", F.col("doc_id").cast("int"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id").cast("int"))
    quality.train(docs, labels)
    for made in (quality.judge(docs, None), nearcopies.classes(docs), repeats.digests(docs), secret_scan.digests(docs)):
        assert made.count() == 20


def test_stages_take_an_empty_benchmark_and_no_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if not test_quality.base(r.text)[5]}
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    rows = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(base)) - before) == 1 and rows.count() > 0
