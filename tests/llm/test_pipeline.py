"""The pipeline's stages on a small table: each decision takes effect and clean documents stay."""

import random

import corpus_pipeline
from keysieve.llm.common import landed


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    item, copied, clean = text(25), text(80), [text(70) for _ in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(clean)]
    rows += [(50, "too short", "en", "a", 9), (51, None, None, None, None), (52, f"{text(30)} {item} {text(30)}", "en", "b", 1),
             (60, copied, "en", "a", 1), (61, copied, "en", "b", 1), (62, copied + " end", "en", "b", 1), (63, text(40) + " mail x@y.org", "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, landed(stage(spark, docs, str(tmp_path)), name)
        kept.append(sorted({r["doc_id"] for r in docs.collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "pii":
            found = {r["doc_id"]: r for r in docs.collect()}
            assert found[63]["text"].endswith("mail <EMAIL>") and found[63]["n_chars"] == len(found[63]["text"])
            assert all(found[i]["text"] == t for i, t in enumerate(clean))
    ids = list(range(12))
    assert kept == [ids + [52, 60, 61, 62, 63], ids + [52, 60, 63], ids + [60, 63], ids + [60, 63], ids + [60, 63]]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r["doc_id"] for r in whole.collect()} == set(ids + [60, 63])
