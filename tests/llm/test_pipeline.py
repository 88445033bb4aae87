"""The pipeline against the same stages in plain Python, each over all that the one before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
import pandas as pd

from tesselwork.llm import quality_model
from tesselwork.llm.catalog import vocabulary
from tesselwork.llm.tokens import id_bytes


def test_pipeline(spark, folder):
    from test_results import components_of

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, weights = docs.columns, quality_model.fit(docs)
    good = corpus_pipeline.quality(spark, docs, folder)
    raw = pd.read_parquet(f"{folder}/documents.parquet")
    raw = raw[raw.text.map(lambda t: quality_model.score(t, weights) >= 0.5)]
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(raw.doc_id)

    once = corpus_pipeline.near_dup(spark, good, folder)
    label = components_of(dict(zip(raw.doc_id, raw.text, strict=True)), 5)
    raw = raw[raw.doc_id.map(lambda i: label[i] == i)]
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(raw.doc_id)

    safe = corpus_pipeline.personal_data(spark, once, folder)
    rows = safe.collect()
    assert safe.columns == columns and all(r.n_chars == len(r.text) for r in rows)
    assert not any("@" in w and w.endswith(".com") for r in rows for w in r.text.split())

    mixed = corpus_pipeline.source_mix(spark, safe, folder).collect()
    sizes = {r.doc_id: len(r.text.split()) for r in rows}
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and abs(sum(sizes[i] * n for i, n in times.items()) / sum(sizes.values()) - 1) < 0.05

    packed = corpus_pipeline.packing(spark, spark.createDataFrame(mixed, safe.schema), folder).toPandas()
    of = id_bytes(vocabulary())
    assert packed.length.sum() == sum(len(of(r.text)) // 4 + 1 for r in mixed)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_on_odd_rows(spark, odd, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        rows = out.collect()
        assert rows and stage(spark, empty, folder).collect() == [], name
        if name != "packing":
            assert out.columns == odd.columns, name
    kept = [r.doc_id for r in corpus_pipeline.near_dup(spark, odd, folder).collect()]
    assert kept.count(4) == 1 and 5 not in kept and kept.count(None) == 2 and 1 in kept and 2 in kept and 8 in kept
    mixed = [r.doc_id for r in corpus_pipeline.source_mix(spark, odd, folder).collect()]
    assert not {1, 2, 8} & set(mixed) and max(map(mixed.count, set(mixed))) <= 6  # 5 stands twice


def test_run_is_its_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert rows(docs) == rows(corpus_pipeline.run(spark, folder))


def test_run_again_gives_the_same(spark, folder):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert a and hashlib.sha256(str(a).encode()).hexdigest() == hashlib.sha256(str(b).encode()).hexdigest()
