"""The pipeline's stages on a small corpus and the registry's names."""

import random
import re

import corpus_pipeline

from fusegrid.llm import registry

from .helpers import table


def test_registry_and_stages():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(20)) + "." for _ in range(n))
    rows = [(k, text(6)) for k in range(6)]
    rows.append((10, rows[0][1].replace("w1", "v1", 1)))  # a near copy by lines is cut by line dedup
    rows.append((11, "too short."))
    rows.append((12, None))
    shared = rows[1][1].split("\n")[0]
    rows.append((13, shared + "\n" + text(6)))
    leak = " ".join(f"b{k}" for k in range(12))
    rows.append((14, text(5) + "\n" + leak + " and more words here to end."))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == {0, 1, 2, 3, 4, 5, 10, 13, 14}
    assert {0, 1, 2, 3, 4, 5, 13, 14} <= kept[1]
    assert 14 in kept[2] and kept[3] == kept[2] - {14} == kept[4]
    lines = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert shared in lines[1] and shared not in lines[13] and not re.search("w", lines.get(10, "")) or 10 in lines
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == kept[4]
