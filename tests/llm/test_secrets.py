import random
import re

import pyarrow as pa

from marketlake.llm.secrets import CANDIDATE, KINDS, LEAST_VALUES, SYMBOLS, Automaton, all_spans, base_spans, find_secrets, learn, learn_from, redact

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", " ", ":", "=", "'", '"', "abc123", "x", "AKIA", "A1B2C3D4E5F6G7H8", "é", "toKen=abcdefg", "0123456789abcdef", "deadbeef", "-", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(t) if ok(m))
        assert [x[:3] for x in base_spans(t)] == want, t
    assert base_spans("a" * 50_000) == [(0, 2, 50_000, "a" * 50_000)]


def test_automaton_merges_and_scores():
    r = random.Random(4)
    values = ["key-" + "".join(r.choice("0123456789ABCDEF") for _ in range(24)) for _ in range(200)]
    made = Automaton.infer(values)
    assert 10 < len(made.step) < 60 and sum(n[""] for n in made.count) == 200
    found = learn(values, ["ordinary", "words", "written", "here"])
    fresh = "key-" + "".join(r.choice("0123456789ABCDEF") for _ in range(24))
    assert found.scores(fresh)[0] >= found.automata[0][1] > found.scores("ordinarywordswrittenhere12")[0]


def test_find_and_redact(spark):
    r = random.Random(6)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20)) + "".join(r.choice("0123456789ABCDEF") for _ in range(20))
    docs = [(i, f"login password = {key()} and words") for i in range(80)] + [(100, "bare " + key() + " here"), (101, None), (102, ""), (103, "plain text only, nothing-to-see-here2"), (103, "plain"), (104, "w " * 60_000)]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, spans int")
    found = learn_from(df)
    got = {}
    for x in find_secrets(df, found).collect():
        got.setdefault(x.doc_id, []).append([(s.kind, s.start, s.end) for s in x.spans])
    assert got[0] == [[("assign", 6, 57)]] and got[100] == [[("format", 5, 45)]]
    assert got[101] == got[102] == got[104] == [[]] and got[103] == [[], []]
    clean = redact(df, found)
    assert clean.columns == df.columns
    assert {x.text for x in clean.where("doc_id in (0, 100, 101)").collect()} == {"login [SECRET] and words", "bare [SECRET] here", None}
    empty = df.limit(0)
    assert learn_from(empty) is None and find_secrets(empty, None).count() == 0


def test_background_of_all_texts_and_parts_beside_base_spans(spark):
    r = random.Random(7)
    key = lambda n: "".join(r.choice("GHJKLMNPQRSTVWXYZ23456789") for _ in range(n))
    docs = [(i, f"login password = {key(8 if i % 2 else 24)} and words") for i in range(200)]
    run = "0123456789abcdef" * 2
    left, short = key(20), key(9)
    docs += [(300, f"bare {left}{run} here"), (301, f"bare {short} here")] + [(400, "")] * 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = learn_from(df)
    share = lambda c: found.plain[0, 1 + SYMBOLS.index(c)]
    assert share("w") > share("b") > share("z")
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in find_secrets(df, found).collect()}
    assert got[300] == [("format", 5, 25), ("hex", 25, 57)]
    assert got[301] == [("format", 5, 14)] and got[400] == [] and got[0] == [("assign", 6, 41)]


def test_planted_formats_are_found_and_words_are_not(spark):
    """Two labelled formats, then bare credentials of both among clean texts; the score equals a plain reading of the automaton."""
    r = random.Random(9)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    one, two = (lambda: "ghx_" + draw("abcdefghijklmnopqrstuvwxyz0123456789", 30)), (lambda: draw("0123456789ABCDEF", 8) + "-" + draw("0123456789ABCDEF", 12))
    words = [draw("etaoinshrdlu", r.randrange(2, 12)) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, f"{prose(30)} token: {(one, two)[i % 2]()} {prose(30)}") for i in range(150)]
    docs += [(1000 + i, f"{prose(30)} {(one, two)[i % 2]()} {prose(30)}") for i in range(200)]
    docs += [(2000 + i, f"{prose(40)} +1 (389) 555-{r.randrange(1000, 9999)} 2023-11-{r.randrange(10, 29)} {r.randrange(10**6, 10**9)} {prose(40)}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = learn_from(df)
    automaton, least = found.automata[0]
    assert len(automaton.step) > 30
    got = {x.doc_id: [s.kind for s in x.spans] for x in find_secrets(df, found).collect()}
    assert sum("format" in got[1000 + i] for i in range(200)) >= 180
    assert sum("format" in got[2000 + i] for i in range(400)) <= 4
    for value in (one(), two(), "ordinary", "x" * 40):
        plain = sum(found.plain[0 if i == 0 else 1 + SYMBOLS.index(value[i - 1]), 0 if i == len(value) else 1 + SYMBOLS.index(value[i])] for i in range(len(value) + 1))
        assert abs(found.scores(value)[0] - (automaton.likelihood(value) - plain) / len(value)) < 1e-9


def test_few_labels_and_many_card_numbers(spark):
    """Too few labelled values teach nothing; with enough of them numbers are still no format."""
    r = random.Random(21)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    number = lambda: draw("0123456789", 16)
    key = lambda: draw("abcdefghijklmnopqrstuvwxyz0123456789", 20)
    words = [draw("etaoinshrdlu", r.randrange(2, 12)) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    for labels in (11, 60):
        docs = [(i, f"{prose(20)} secret={key() if i % 3 else number()} {prose(20)}") for i in range(labels)]
        docs += [(1000 + i, f"{prose(30)} {number()} {prose(10)} 2024-{r.randrange(10, 13)}-{r.randrange(10, 29)} {draw('0123456789', 9)} {prose(5)}") for i in range(300)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        found = learn_from(df)
        assert (found is None) == (labels < LEAST_VALUES)
        spans = {x.doc_id: [s.kind for s in x.spans] for x in find_secrets(df, found).collect()}
        assert not any("format" in spans[1000 + i] for i in range(300))


def test_long_values_teach_a_tail():
    r = random.Random(10)
    values = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (300, 400, 40, 500) * 10]
    made = Automaton.infer(values, longest=20)
    assert len(made.step) <= 30 and sum(n[""] for n in made.count) == 40 and made.likelihood("abc" * 50) > -150 * 6.1


def test_scoring_many_at_once_equals_one_at_a_time():
    r = random.Random(12)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    key = lambda: draw("0123456789abcdef", r.choice((16, 20)))
    found = learn({"assign": [key() for _ in range(80)], "access": [], "hex": ["k-" + draw("xyz0123456789", 12) for _ in range(80)]}, ["words of all kinds, and 12 numbers 2024"] * 50)
    bits = [key, lambda: "k-" + draw("xyz0123456789", 12), lambda: "é.", lambda: " ", lambda: "\n", lambda: "words", lambda: "pass", lambda: "token=" + key(), lambda: "x" * 700, lambda: key() * 40]
    texts = [None, "", *["".join(r.choice(bits)() for _ in range(r.randrange(1, 9))) for _ in range(400)]]
    got = all_spans(pa.array(texts), found)
    seen = 0
    for t, spans in zip(texts, got, strict=True):
        base = base_spans(t or "")
        want = list(base)
        for m in CANDIDATE.finditer(t or ""):
            at, cuts = m.start(), [(a, b) for a, _, b, _ in base if b > m.start() and a < m.end()]
            for a, b in [*sorted(cuts), (m.end(), m.end())]:
                piece = t[at : max(at, min(a, m.end()))]
                if len(piece) >= 6 and found.reported(piece):
                    want.append((at, len(KINDS), at + len(piece), piece))
                at = max(at, b)
        assert spans == sorted(want), t
        seen += len(want) - len(base)
    assert seen > 100
