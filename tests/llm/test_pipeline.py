import random

from llm_helpers import corpus, frame


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline
    from cirrus.llm.common import durable

    rng = random.Random(1)
    texts = [r for r in corpus() if r[0] is not None and r[1] is not None]
    texts += [(100 + i, " ".join(f"w{rng.randrange(300)}x" for _ in range(60)) + (" horrid vilest" if i % 2 else "")) for i in range(200)]
    item = " ".join(texts[7][1].split()[2:30])
    docs = frame(spark, texts)
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        counts.append(docs.count())
    assert counts[1] <= counts[0] - 90 and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    ids = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert not any(i % 2 for i in ids if i >= 100)
    assert item.split()[9] + " " + item.split()[10] not in ids[7]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(ids) and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
