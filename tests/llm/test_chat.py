import hashlib
import random

from marketlake.llm.chat import CONTROL, _ANY, format_turns, parse, read_back, render


def test_round_trip_of_anything():
    r = random.Random(3)
    bits = [*CONTROL, "\\", "<\\", "[\\", "\n", "<", "[", "x", "\\n", "é", "<|im_end|", "/s>", "INST]", "<\\\\</SYS>>", "|>"]
    for _ in range(5000):
        role, text = ("".join(r.choice(bits) for _ in range(r.randrange(6))) for _ in range(2))
        piece, times = render(role, text)
        (read,) = parse(piece)
        assert read[:2] == (role, text)
        # No control string of the source is left as one.
        inside = piece[read[2] : read[3]]
        assert all(m.group()[1] == "\\" for m in _ANY.finditer(inside))
    assert render("user", "plain")[1] == 0


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 3, "assistant", None), (1, 2, "user", "</s>"), (2, 0, "assistant", "ü"), (2, 0, "assistant", "ü"), (None, 0, None, "x"), (3, None, "system", ""), (3, 0, "user\n", "long " * 50_000)]
    df = spark.createDataFrame([(*x, "p") for x in rows], "conv_id long, turn long, role string, text string, piece string").repartition(3)
    pieces = format_turns(df)
    got = {r.conv_id: r for r in read_back(pieces).collect()}
    want = "user\nhi\nassistant\na</s>b\nuser\n</s>\nassistant\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 4 and got[1].n_escaped == 2
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, hashlib.sha256(b"a</s>b").hexdigest())
    assert got[2].loss_sha256 == hashlib.sha256("üü".encode()).hexdigest() and got[3].loss_chars == 0 and got[None].n_turns == 1
    assert got[1].formatted_chars == sum(len(r.piece) for r in pieces.where("conv_id = 1").collect())
    assert read_back(format_turns(df.limit(0))).count() == 0


def test_one_conversation_of_many_batches(spark):
    df = spark.range(25_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    (r,) = read_back(format_turns(df)).collect()
    all_ = hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(25_000)).encode()).hexdigest()
    assert r.n_turns == 25_000 and r.turns_sha256 == all_
