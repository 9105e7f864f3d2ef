import hashlib
import random
import re

from marketlake.llm.pii import report, sanitise

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def case():
    r = random.Random(5)
    bits = ["a@b.co", "a@b.c_d@e.f", "x.y+z@mail-1.example.com", "@a.b", "..@a.b.c-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.0255", "10.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "4242424242424242", "0 0 0 0 0 0 0 0 0 0 0 0 0", "+1 (555) 010-9999", "+44 20 7946 0958.", "+1.", "+123456789", "+1234567890123456", "été", "𝒳", "word", "\n", " ", " ", "-", "5"]
    docs = [(0, None), (1, ""), (2, "1" * 30_000), (3, "a" * 30_000), (4, "1 " * 15_000), (5, "a." * 15_000 + "@b.c"), (6, "1.2.3.4 " * 2000)]
    for d in range(7, 300):
        docs.append((d, "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))))
    return docs


def test_base_spans_equal_brute_force(spark):
    docs = case()
    got = {r.doc_id: r for r in report(spark.createDataFrame([(*x, "u") for x in docs], "doc_id long, text string, row string"), support=10**6).collect()}
    for d, text in docs:
        want = brute(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in BASE), (d, text)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans == line, (d, text)


def test_disclosing_terms(spark):
    docs = [(i, f"note {i}: Zebulon, called {x} at +1 (555) 010-{i:04d}; write zed@corp.example now") for i, x in enumerate(["red", "blue", "green", "grey"])]
    docs += [(i, f"ordinary text called now {i}") for i in range(10, 60)] + [(70, None), (70, "repeat a@b.cd"), (70, "repeat a@b.cd")]
    df = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, base_spans string")
    got = {}
    for r in report(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[70]) == 3
    text = docs[0][1]
    at = text.index("Zebulon")
    assert f"term:{at}:{at + 7}" in got[0][0].spans and got[0][0].spans.startswith("email:")
    assert all("term" not in r.spans for d in got for r in got[d] if d >= 10)
    clean = {r.text for r in sanitise(df).collect()}
    assert sanitise(df).columns == df.columns and "repeat [EMAIL]" in clean and None in clean
    # "note" and "write" too occur nowhere else in this corpus; "called" and "now" do.
    assert "[TERM] 0: [TERM], called red at [PHONE]; [TERM] [EMAIL] now" in clean


def test_copies_of_a_text_count_once(spark):
    docs = [(i, f"note {i}: Zebulon, called {x}; write zed@corp.example now") for i, x in enumerate(["red", "blue", "green", "grey"])] * 10
    docs += [(i, f"ordinary text called now {i}") for i in range(10, 60)]
    got = report(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 0").collect()
    at = docs[0][1].index("Zebulon")
    assert len(got) == 10 and all(f"term:{at}:{at + 7}" in r.spans for r in got)


def test_terms_far_from_the_entity_and_short_names(spark):
    r = random.Random(1)
    fill = lambda: " ".join(r.choice(["plain", "words", "that", "all", "texts", "hold"]) for _ in range(40))
    docs = [(i, f"Li Zebulon {fill()} mail {i} to zed@corp.example and {fill()}") for i in range(4)]
    docs[0] = (0, f"{fill()} mail 0 to zed@corp.example of Li Zebulon")
    docs += [(i, f"to mail and of {fill()}") for i in range(10, 60)]
    got = {x.doc_id: x.spans for x in report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(4):
        at = docs[i][1].index("Li")
        assert [f"term:{at}:{at + 2}", f"term:{at + 3}:{at + 10}"] == [x for x in got[i].split(",") if x.startswith("term")]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert report(empty).count() == 0 and sanitise(empty).count() == 0
