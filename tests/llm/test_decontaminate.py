import hashlib
import random
import re

from marketlake.llm.decontaminate import decontaminate, longest_matches, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for i, t in items:
            v = WORD.findall(low(t))
            for k in range(max(len(v) - 9, 1) if v else 0):
                part = v[k : k + 10]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit.update(range(p, p + len(part)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def case():
    r = random.Random(3)
    v = [f"w{i}" for i in range(12)] + ["Été", "x9"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 3, 9, 10, 11, 30, 30])))) for i in range(6)] + [(100, None), (101, ""), (102, "One lone-word")]
    items[0] = (0, "unusual")
    docs = [(0, None), (1, ""), (2, "Unusual"), (3, "one, LONE word"), (4, "a" * 50_000)]
    for d in range(5, 40):
        w = [r.choice(v) for _ in range(r.randrange(60))]
        if d % 2:
            t = (items[r.randrange(1, 6)][1] or "").split()
            a = r.randrange(len(t))
            w[5:5] = t[a : a + r.randrange(1, 25)]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w)))
    docs.append((40, " ".join([items[5][1]] * 50)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (16, 0.0003):
        got = {r[0]: tuple(r)[1:6] for r in report(df.select("doc_id", "text"), bench, block_mb=block).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate(df, bench).collect()}
    assert kept == {d for d, x in want.items() if not x[4]}


def test_longest_match_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(30))
    df = spark.createDataFrame([(1, "x " + " ".join(f"q{i}" for i in range(4, 22)) + " y"), (1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    assert sorted(r.longest_match for r in longest_matches(df, bench).collect()) == [18, 30]
    assert report(df.limit(0), bench).count() == 0
    assert [r.contaminated for r in report(df, bench.limit(0)).collect()] == [False, False]


def test_rows_of_one_key_stay_apart_in_blocks_and_items_without_id_hit(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, item + " a b c"), (1, "clean"), (None, item), (None, "clean too"), (None, "clean too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (3, " ".join(f"z{i}" for i in range(30)))], "item_id long, text string")
    want = sorted([(15, 12, 1), (1, 0, 0), (12, 12, 1), (2, 0, 0), (2, 0, 0)])
    for block in (16, 0.00005):
        assert sorted((r.n_words, r.n_hit, r.n_items) for r in report(df, bench, block_mb=block).collect()) == want


def test_items_that_share_windows(spark):
    """Many items with one passage, documents that hold it often: every item is named, and nothing is counted twice."""
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(f"i{k:03}", f"a{k} {passage} b{k} c{k}") for k in range(200)] + [("same", items_text := passage), ("same2", items_text)]
    docs = [(1, f"x {passage} " * 50), (2, "x " + " ".join(passage.split()[:10]) + " y"), (3, " ".join(passage.split()[:9])), (4, f"q a7 {passage} b7 z")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in longest_matches(d, b).collect()}
    every = sorted(name for name, _ in items)
    assert got[1]["items"] == every and got[1].longest_match == 14 and sum(s.end - s.first for s in got[1].spans) == 14 * 50
    assert got[2]["items"] == every and got[2].longest_match == 10 and got[3]["items"] == [] and got[4].longest_match == 16
