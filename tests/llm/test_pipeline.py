import random

from pyspark.sql import functions as F

import corpus_pipeline
from marketlake.llm.jaccard import jaccard_components


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    item = " ".join(word() for _ in range(30))
    docs, labels = [], []
    for d in range(240):
        text = " ".join(word() for _ in range(r.randrange(20, 60)))
        good = d % 5 > 0
        docs.append((d, text if good else " ".join(f"{w.upper()}!!" for w in text.split()), r.choice(["en", "fr"]), f"src{d % 3}"))
        labels.append((d, int(good), 0))
    docs += [(1000 + d, docs[d][1], "en", "src0") for d in (1, 2, 3)]
    docs += [(2000, docs[6][1] + " " + item, "en", "src1"), (2001, " ".join(word() for _ in range(40)) + " write me at some.one@mail.example.org now", "en", "src1"), (2002, None, None, None), (2003, "", "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = df, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out{i}")
        now = spark.read.parquet(f"{tmp_path}/out{i}")
        kept[name] = {x.doc_id: x.text for x in now.collect()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == df.columns
    quality, near, leaks, private, mixed = kept.values()
    assert {d for d in range(240) if d % 5} <= quality.keys() and not {d for d in range(240) if d % 5 == 0} & quality.keys()
    assert not {1001, 1002, 1003} & near.keys() and {1, 2, 3, 6, 7, 2002, 2003} <= near.keys()
    assert set(near) - set(leaks) == {2000}
    assert private.keys() == leaks.keys() and "[EMAIL]" in private[2001] and "@" not in private[2001]
    assert mixed.keys() <= private.keys() and len(mixed) > 100
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == mixed.keys()
    assert jaccard_components(df).count() == len(docs)


def test_rows_are_judged_not_keys(spark, tmp_path):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    leak, one, two, same = text(), text(), text(), text()
    docs = [(None, leak), (None, one), (5, "x " + leak), (5, two), (None, same), (None, same), (9, same), (5, same)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.remove_leaks(spark, corpus_pipeline.deduplicate(spark, df, str(tmp_path)), str(tmp_path))
    assert got.columns == df.columns
    assert sorted((x.text, x.doc_id or 0) for x in got.collect()) == sorted([(one, 0), (two, 5), (same, 5)])
