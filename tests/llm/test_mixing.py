import math
import re

import numpy as np

from marketlake.llm.mixing import marginal_errors, mix, rake


def test_raked_marginals_meet_targets(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(r.integers(0, 5000))) for i in range(6) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25, "none": 9.0}}
    got = rake(cells, targets, rounds=20).toPandas()
    assert math.isclose(got.w.sum(), 1, abs_tol=1e-9) and (got.tokens > 0).all()
    lang = got.groupby("lang").w.sum()
    assert abs(lang["l0"] - 0.5) < 1e-6
    errors = [{r.dimension: r.error for r in marginal_errors(rake(cells, targets, rounds=n), targets).collect()} for n in (1, 20)]
    assert max(errors[0].values()) > 1e-4 and max(errors[1].values()) < 1e-6
    share = got.groupby("source").tokens.sum() ** 0.7
    assert np.allclose(got.groupby("source").w.sum(), share / share.sum(), atol=1e-6)
    # Against plain fitting of the same table.
    w = got.assign(w=got.tokens.astype(float)).set_index(["source", "lang", "topic"]).w.sort_index()
    topic = got.groupby("topic").tokens.sum() ** 0.7
    for _ in range(20):
        for d, goal in (("source", share / share.sum()), ("lang", {"l0": 0.5, "l1": 0.25, "l2": 0.25}), ("topic", topic / topic.sum())):
            have = w.groupby(d).transform("sum")
            w = w * w.index.get_level_values(d).map(dict(goal)).to_numpy() / have
    assert np.allclose(got.set_index(["source", "lang", "topic"]).w.sort_index(), w, rtol=1e-9)


def test_draws_and_odd_rows(spark):
    docs = [(i, "word " * (i % 50 + 1), f"s{min(i % 7, 3)}", "en" if i % 3 else "fr") for i in range(3000)]
    docs += [(9000, None, "s0", "en"), (9001, "", None, None), (9002, "x y", None, None), (9002, "x y", None, None), (None, "z", "s1", "en")]
    df = spark.createDataFrame([(*x, 1.5) for x in docs], "doc_id long, text string, source string, lang string, mix_rate double")
    got = mix(df).toPandas()
    assert (got.mix_copies >= 1).all() and list(got.columns) == ["doc_id", "text", "source", "lang", "mix_topic", "mix_rate", "mix_copies"]
    tokens = got.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    drawn, all_ = (tokens * got.mix_copies).sum(), sum(i % 50 + 1 for i in range(3000))
    assert abs(drawn / all_ - 1) < 0.1
    assert len(got[got.doc_id == 9002]) in (0, 2)
    again = mix(df.repartition(5)).toPandas()
    assert sorted(again.doc_id.fillna(-1)) == sorted(got.doc_id.fillna(-1))
    assert mix(df.limit(0)).count() == 0


def test_topics_of_a_column(spark):
    df = spark.createDataFrame([(i, "word " * 20, "s", "en", "a" if i % 4 else None) for i in range(400)], "doc_id long, text string, source string, lang string, kind string")
    got = mix(df, topic="kind", targets={"topic": {"a": 0.5, "prose": 0.5}}).toPandas()
    assert set(got.mix_topic) == {"a", "prose"} and abs(got[got.mix_topic == "prose"].mix_copies.sum() / 200 - 1) < 0.2
