r"""Chat formatting whose output reads back to exactly what went in.

A turn is written as

    <|im_start|>ROLE newline TEXT<|im_end|> newline

and read by a deterministic parser.  Every turn makes the round trip as it is
formatted: it is rendered plainly, parsed, and compared with its source; while
they differ (the text holds a control string of this template or of another
one, or something that looks escaped) its content is escaped and it is rendered
again.  Escaping puts a backslash after the first character of each control
string, one more where there are some already; reading takes one away.

The result is a row per turn: the piece of formatted text, and the span of it
that counts for the loss (the text of assistant turns).  The pieces of a
conversation, in order of `turn`, then role, then the piece, are its formatted text;
`read_back` parses them in that order and keeps only running digests, so a
conversation of any length, or one that holds a third of all rows, needs no
more memory than its longest turn.

Null texts and roles count as empty, a null turn comes first, rows without a
conversation id are one conversation, and repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"

#: Strings that chat templates in common use treat as control.
CONTROL = (
    START, STOP, "<|im_sep|>", "<|endoftext|>", "<|endofprompt|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|eom_id|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>",
)
_AFTER_ANGLE = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "<")
_AFTER_SQUARE = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "[")
PATTERN = rf"<\\*(?:{_AFTER_ANGLE})|\[\\*(?:{_AFTER_SQUARE})"
_ANY = re.compile(PATTERN)


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    """A role cannot hold a line break, which ends the header, so it is written as two characters."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(piece: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the text as written) of each turn; raises on what no turn is."""
    out, at = [], 0
    while at < len(piece):
        if not piece.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = piece.find("\n", at)
        stop = piece.find(STOP + "\n", line)
        if line < 0 or stop < 0:
            raise ValueError(f"the turn at {at} has no end")
        if any(m[0][1] != "\\" for x in (piece[at + len(START) : line], piece[line + 1 : stop]) for m in _ANY.finditer(x)):
            raise ValueError(f"the turn at {at} holds a control string")
        out.append((unescape_role(piece[at + len(START) : line]), unescape(piece[line + 1 : stop]), line + 1, stop))
        at = stop + len(STOP) + 1
    return out


def _same(piece: str, role: str, text: str) -> bool:
    try:
        read = parse(piece)
    except ValueError:
        return False
    return len(read) == 1 and read[0][:2] == (role, text)


def render(role: str, text: str) -> tuple[str, int]:
    """The piece of a turn, and how often it had to be escaped until it read back the same."""
    written_role, written = role, text
    for times in range(2):
        piece = f"{START}{written_role}\n{written}{STOP}\n"
        if _same(piece, role, text):
            return piece, times
        written_role, written = escape_role(role), escape(text)
    piece = f"{START}{written_role}\n{written}{STOP}\n"
    if not _same(piece, role, text):
        raise ValueError("a turn does not read back")
    return piece, 2


_PIECES = "turn long, role string, piece string, escaped int, loss_begin int, loss_end int"


def format_turns(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, piece, escaped, loss_begin, loss_end) of every row; the loss span is in code points of the piece."""
    kind = conversations.schema[conv].dataType.simpleString()
    rows = conversations.select(F.col(conv), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, times, begin, end = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                piece, n = render(role, text)
                a, b = parse(piece)[0][2:] if role == "assistant" else (0, 0)
                pieces.append(piece)
                times.append(n)
                begin.append(a)
                end.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("turn"), batch.column("role"), pa.array(pieces, pa.string()), *[pa.array(x, pa.int32()) for x in (times, begin, end)]], names=[conv, "turn", "role", "piece", "escaped", "loss_begin", "loss_end"])

    return rows.mapInArrow(apply, f"`{conv}` {kind}, {_PIECES}")


class _Reading:
    """Running digests of one conversation."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.loss = conv, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.chars = self.escaped = 0

    def add(self, piece: str, escaped: int, begin: int, end: int) -> None:
        for role, text, *_ in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(piece[begin:end])
        self.loss += len(masked)
        self.masked.update(masked.encode())
        self.chars += len(piece)
        self.escaped += escaped > 0

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.escaped


_NAMES = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def read_back(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row per conversation, parsed from its pieces in order."""
    kind = pieces.schema[conv].dataType.simpleString()
    ordered = pieces.repartition(conv).sortWithinPartitions(conv, "turn", "role", "piece")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        of_type = None
        for batch in batches:
            of_type, done = batch.column(0).type, []
            for c, piece, escaped, begin, end in zip(*[batch.column(x).to_pylist() for x in (conv, "piece", "escaped", "loss_begin", "loss_end")], strict=True):
                if now is None or now.conv != c:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(c)
                now.add(piece, escaped, begin, end)
            if done:
                yield _batch(done, of_type, conv)
        if now is not None:
            yield _batch([now.row()], of_type, conv)

    types = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"
    return ordered.mapInArrow(apply, f"`{conv}` {kind}, {types}")


def _batch(rows: list[tuple], kind: pa.DataType, conv: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (kind, *_TYPES), strict=True)], names=[conv, *_NAMES])


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_turns(rows.unionByName(more)))


_SQL_PATTERN = PATTERN.replace("'", "''")
OP3_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, len(regexp_extract_all(text, '{_SQL_PATTERN}')) as hits from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(text) + hits + {len(START) + len(STOP) + 2}) as bigint) as formatted_chars,
  cast(count(*) filter (hits > 0) as bigint) as n_escaped
from sized group by conv_id
"""
