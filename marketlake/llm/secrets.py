r"""Secrets by patterns, and by the format that labelled credentials have.

Base spans are the stated `assign`, `access` and `hex` patterns.  The method
adds `format` spans: credentials found by the patterns are the labelled
examples.  For each kind a prefix tree is built from a bounded sample of distinct
ones (`train_values`, those with the smallest hash); states deeper than `LONGEST`
are one.  States are merged where their statistics agree (G tests on what follows
them, symbols and ends alike): first those of one depth, the most frequent first,
so that evidence gathers before it is judged, then any.  So lengths and fixed
parts stay as states of the probabilistic automaton, while random parts fold.
The sample holds whole values of up to `LONGEST_VALUE` characters; a kind with fewer
than `LEAST_VALUES` of them has no automaton, since a few values cannot tell a format
from chance.

Every run of `[A-Za-z0-9+/_=-]` of 6 characters or more, in every whole text, is
a candidate; of one that base spans touch, the parts outside them are.  Its score
under a kind is the mean log2 likelihood ratio per character of the automaton
against characters of all texts outside base spans, each given the one before
it, or against numbers and dates, where it is made of digits and marks alone: there each
character has a tenth, whatever the length, so digits that only look drawn at random are
no format.  It is reported if it reaches `ENOUGH` of the score that all but the lowest
hundredth of the labelled credentials of a kind have.

Null texts count as empty.  Each row is judged by its own text alone, so
repeated rows and ties give equal results; without labelled credentials there
are no format spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import held
from marketlake.llm.words import flat, slices

KINDS = ("assign", "access", "hex")
FORMAT = "format"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
KEYWORDS = ("passw", "secret", "token", "api")

TRAIN_VALUES, LEAST_VALUES, LONGEST_VALUE = 400, 24, 4096
LONGEST = 128
ALPHA = 0.001
SHORTEST = 6
ENOUGH, LEAST, EVIDENCE = 0.6, 0.25, 10.0
#: Weight of the shares of single characters in those of pairs, in characters.
PRIOR = 1000
#: No character counts as rarer than this after another, so that one seen nowhere else does not decide alone.
RAREST = 1 / 1024
#: log2 of the share of each character in numbers and dates, and what these are made of.
NUMBER = log2(0.1)
_DATED = np.zeros(256, bool)
_DATED[[ord(c) for c in "0123456789+/_=-"]] = True
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: What stands for the end of a string, and for all other characters.
NONE = ""
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS)) + 1
_SIZE = len(SYMBOLS) + 1
#: The same for characters that a candidate may have.
_INSIDE = _CODE.copy()
_INSIDE[ord(".")] = 0
#: Longer candidates are scored one at a time.
_TOGETHER = 512


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret), by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def _differ(x: Counter, y: Counter, critical: dict[int, float]) -> bool:
    """Is it beyond chance that what follows two states has one distribution?  Too few observations say nothing."""
    n, m = x.total(), y.total()
    every = x.keys() | y.keys()
    if len(every) < 2 or not n or not m or n + m < 3 * len(every):
        return False
    g = 0.0
    for c in every:
        i, j = x[c], y[c]
        both = (i + j) / (n + m)
        g += (i * log(i / (n * both)) if i else 0.0) + (j * log(j / (m * both)) if j else 0.0)
    return 2 * g > critical[len(every) - 1]


def _critical(alpha: float) -> dict[int, float]:
    """Chi-square bounds by degrees of freedom (Wilson and Hilferty)."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(mid / math.sqrt(2)) > alpha else (low, mid)
    return {k: k * (1 - 2 / (9 * k) + low * math.sqrt(2 / (9 * k))) ** 3 for k in range(1, 2 * _SIZE)}


@dataclass
class Automaton:
    """Probabilistic automaton: per state the next state of each symbol, and how often each symbol, or the end, follows."""

    step: list[dict[str, int]] = field(default_factory=list)
    count: list[Counter] = field(default_factory=list)

    @staticmethod
    def tree(values: list[str], longest: int = LONGEST) -> Automaton:
        made = Automaton([{}], [Counter()])
        tail = None
        for value in values:
            q = 0
            for depth, c in enumerate(value):
                if c not in made.step[q]:
                    if depth >= longest and tail is not None:
                        made.step[q][c] = tail
                    else:
                        made.step.append({})
                        made.count.append(Counter())
                        made.step[q][c] = len(made.step) - 1
                        if depth >= longest:
                            tail = len(made.step) - 1
                made.count[q][c] += 1
                q = made.step[q][c]
            made.count[q][NONE] += 1
        return made

    def _alike(self, a: int, b: int, critical: dict[int, float]) -> bool:
        """Do two states of one depth, and what follows them as far as both were seen twice, differ by chance only?"""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            if _differ(self.count[p], self.count[q], critical):
                return False
            for c, t in self.step[q].items():
                u = self.step[p].get(c)
                if u is not None and self.count[p][c] > 1 and self.count[q][c] > 1:
                    todo.append((u, t))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add what follows b to what follows a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            self.count[p].update(self.count[q])
            for c, t in self.step[q].items():
                if c in self.step[p]:
                    todo.append((self.step[p][c], t))
                else:
                    self.step[p][c] = t

    def _layers(self, critical: dict[int, float]) -> list[int]:
        """Merges states of one depth, from the root on; the states that are left, with the shallow first."""
        kept, layer = [0], [0]
        while layer:
            kids = [(p, c, q) for p in layer for c, q in sorted(self.step[p].items()) if q not in kept]
            number = {q: self.count[q].total() for _, _, q in kids}
            found: dict[int, int] = {}
            layer = []
            for q in sorted(number, key=lambda q: (-number[q], q)):
                same = next((r for r in layer if self._alike(r, q, critical)), None)
                if same is None:
                    layer.append(q)
                else:
                    self._fold(same, q)
                found[q] = q if same is None else same
            for p, c, q in kids:
                self.step[p][c] = found[q]
            kept += layer
        return kept

    @staticmethod
    def infer(values: list[str], alpha: float = ALPHA, longest: int = LONGEST) -> Automaton:
        """The prefix tree with compatible states merged."""
        made, critical = Automaton.tree(values, longest), _critical(alpha)
        kept = made._layers(critical)
        n = len(kept)
        number = {q: i for i, q in enumerate(kept)}
        step = [{c: number[t] for c, t in made.step[q].items()} for q in kept]
        count = [made.count[q] for q in kept]
        # Two states differ if what follows them does, or leads to states that differ; the deep are judged first.
        apart = [[False] * n for _ in range(n)]
        for p in range(n - 1, -1, -1):
            for q in range(n - 1, p, -1):
                far = any(apart[min(t, step[q][c])][max(t, step[q][c])] for c, t in step[p].items() if c in step[q] and (t, step[q][c]) != (p, q))
                apart[p][q] = far or _differ(count[p], count[q], critical)
        of = list(range(n))

        def root(q: int) -> int:
            while of[q] != q:
                q = of[q]
            return q

        def merged(p: int, q: int) -> list[int] | None:
            """The classes after a merge and the merges it entails, or None where one is of states that differ."""
            trial, todo = of.copy(), [(p, q)]

            def top(x: int) -> int:
                while trial[x] != x:
                    x = trial[x]
                return x

            while todo:
                x, y = sorted(map(top, todo.pop()))
                if x == y:
                    continue
                mine, yours = ([z for z in range(n) if top(z) == w] for w in (x, y))
                if any(apart[min(i, j)][max(i, j)] for i in mine for j in yours):
                    return None
                trial[y] = x
                for c in {c for z in mine for c in step[z]} & {c for z in yours for c in step[z]}:
                    todo.append((next(step[z][c] for z in mine if c in step[z]), next(step[z][c] for z in yours if c in step[z])))
            return trial

        for q in range(1, n):
            for p in range(q):
                if of[p] == p and root(q) == q and not apart[p][q]:
                    of = merged(p, q) or of
        top = sorted({root(q) for q in range(n)})
        place = {q: i for i, q in enumerate(top)}
        out = Automaton([{} for _ in top], [Counter() for _ in top])
        for q in range(n):
            i = place[root(q)]
            out.count[i].update(count[q])
            out.step[i] |= {c: place[root(t)] for c, t in step[q].items()}
        return out

    def likelihood(self, value: str) -> float:
        """log2 of the probability of the string; symbols not seen in a state have a small share of it."""
        q, out = 0, 0.0
        for c in value:
            out += log2((self.count[q][c] + 0.1) / (self.count[q].total() + 0.1 * _SIZE))
            q = self.step[q].get(c, q)
        return out + log2((self.count[q][NONE] + 0.1) / (self.count[q].total() + 0.1 * _SIZE))


@dataclass
class Format:
    """An automaton for each kind with the least score to report, and the log2 shares of characters after characters."""

    automata: list[tuple[Automaton, float]]
    plain: np.ndarray
    _wide: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] | None = None
    _logs: list[tuple[list[dict[str, tuple[float, int]]], list[float], list[float], float]] | None = None

    def _tables(self) -> list[tuple[list[dict[str, tuple[float, int]]], list[float], list[float], float]]:
        """Per state: the log2 share and next state of each symbol, the share of all others, and of the end."""
        if self._logs is None:
            self._logs = []
            for made, least in self.automata:
                total = [n.total() + 0.1 * _SIZE for n in made.count]
                to = [{c: (log2((n[c] + 0.1) / t), step.get(c, q)) for c in n if c} for q, (n, t, step) in enumerate(zip(made.count, total, made.step, strict=True))]
                self._logs.append((to, [log2(0.1 / t) for t in total], [log2((n[NONE] + 0.1) / t) for n, t in zip(made.count, total, strict=True)], least))
        return self._logs

    def _background(self, value: str) -> float:
        raw = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
        code = _CODE[raw]
        pairs = float(self.plain[np.r_[0, code], np.r_[code, 0]].sum())
        return max(pairs, NUMBER * len(raw)) if _DATED[raw].all() else pairs

    def scores(self, value: str) -> list[float]:
        """The score under each kind."""
        plain, out = self._background(value), []
        for to, other, end, _ in self._tables():
            q, total = 0, 0.0
            for c in value:
                got = to[q].get(c)
                if got is None:
                    total += other[q]
                else:
                    total += got[0]
                    q = got[1]
            out.append((total + end[q] - plain) / len(value))
        return out

    def _good(self, score: np.ndarray | float, least: float, size: np.ndarray | int) -> np.ndarray | bool:
        return (score >= least) & (score * size >= EVIDENCE)

    def reported(self, value: str) -> bool:
        """Does it score as labelled credentials of a kind do?"""
        return any(self._good(score, least, len(value)) for score, (_, least) in zip(self.scores(value), self.automata, strict=True))

    def _arrays(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """The tables as arrays by state and code."""
        if self._wide is None:
            self._wide = []
            for to, other, end, least in self._tables():
                log, step = np.repeat(np.array(other)[:, None], _SIZE, axis=1), np.repeat(np.arange(len(to))[:, None], _SIZE, axis=1)
                for q, row in enumerate(to):
                    for c, (x, t) in row.items():
                        log[q, _CODE[ord(c)]], step[q, _CODE[ord(c)]] = x, t
                self._wide.append((log, step, np.array(end), least))
        return self._wide

    def reported_runs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates among the bytes of texts that begin at `at` and are reported: text, first and last byte."""
        code = _INSIDE[data]
        inside = code > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
        end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
        size = end - start
        rank = np.argsort(-size)
        rank = rank[size[rank] >= SHORTEST]
        start, end, size = start[rank], end[rank], size[rank]
        good = np.zeros(len(start), bool)
        far = int(np.count_nonzero(size > _TOGETHER))
        for i in range(far):
            good[i] = self.reported(data[start[i] : end[i]].tobytes().decode("ascii"))
        s, n = start[far:], size[far:]
        if len(s):
            plain = np.r_[0.0, np.cumsum(self.plain[code[:-1], code[1:]])]
            plain = plain[s + n - 1] - plain[s] + self.plain[0, code[s]] + self.plain[code[s + n - 1], 0]
            dated = np.r_[0, np.cumsum(_DATED[data])]
            plain = np.where(dated[s + n] - dated[s] == n, np.maximum(plain, NUMBER * n), plain)
            live = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # how many are longer than each place
            for log, step, last, least in self._arrays():
                q, total = np.zeros(len(s), np.int64), np.zeros(len(s))
                for j, k in enumerate(live.tolist()):
                    c = code[s[:k] + j]
                    total[:k] += log[q[:k], c]
                    q[:k] = step[q[:k], c]
                good[far:] |= self._good((total + last[q] - plain) / n, least, n)
        start, end = start[good], end[good]
        return np.searchsorted(at, start, "right") - 1, start, end

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_wide": None, "_logs": None}


def characters(texts: list[str]) -> np.ndarray:
    """How often each character (0: none of SYMBOLS, or an edge) stands after each."""
    code = _CODE[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode(), np.uint8)]
    return np.bincount(code[:-1] * _SIZE + code[1:], minlength=_SIZE * _SIZE).reshape(_SIZE, _SIZE)


def learn(values: dict[str, list[str]] | list[str], words: list[str] | np.ndarray, longest: int = LONGEST) -> Format | None:
    """Formats from labelled credentials by kind, and ordinary texts or the counts of their characters."""
    kinds = values if isinstance(values, dict) else {"": values}
    kinds = {k: sorted({x for x in v if len(x) >= SHORTEST}) for k, v in kinds.items()}
    if not any(kinds.values()):
        return None
    seen = (words if isinstance(words, np.ndarray) else characters(words)).astype(float)
    one = (seen.sum(axis=0) + 0.5) / (seen.sum() + 0.5 * _SIZE)
    share = np.maximum((seen + PRIOR * one) / (seen.sum(axis=1, keepdims=True) + PRIOR), RAREST)
    plain = np.log2(share)
    out = []
    for v in (v for v in kinds.values() if len(v) >= LEAST_VALUES):
        halves = [v[::2], v[1::2] or v]
        unseen = sorted(x for mine, other in (halves, halves[::-1]) for made in [Format([(Automaton.infer(mine, longest=longest), 0.0)], plain)] for x in (made.scores(y)[0] for y in other))
        out.append((Automaton.infer(v, longest=longest), max(ENOUGH * unseen[len(unseen) // 20], LEAST)))
    return Format(out, plain) if out else None


def format_spans(text: str, base: list[tuple[int, int, int, str]], found: Format | None) -> list[tuple[int, int, int, str]]:
    if found is None:
        return []
    out, taken = [], sorted((a, b) for a, _, b, _ in base)
    taken.append((len(text), len(text)))
    k = 0
    for m in CANDIDATE.finditer(text):
        at, i = m.start(), k
        while at < m.end():
            # Spans before `at` touch no later part; those of one kind do not overlap, others may.
            while taken[i][1] <= at and i < len(taken) - 1:
                i += 1
            a, b = taken[i]
            stop = max(at, min(a, m.end()))
            if stop - at >= SHORTEST and found.reported(text[at:stop]):
                out.append((at, len(KINDS), stop, text[at:stop]))
            at = m.end() if a >= m.end() else max(stop, b)
        while taken[k][1] <= m.start() and k < len(taken) - 1:
            k += 1
    return out


def _labelled(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Labelled credentials of each batch, and at the end of a task how often each character follows each outside them."""
    names, seen = ["kind", "value", "pair", "n"], np.zeros((_SIZE, _SIZE), np.int64)
    for batch in batches:
        values, plain = set(), []
        for t in batch.column(text).to_pylist():
            if t:
                base, at = base_spans(t), 0
                values.update((k, s) for _, k, _, s in base if SHORTEST <= len(s) <= LONGEST_VALUE)
                for a, _, b, _ in base:
                    plain.append(t[at:a])
                    at = max(at, b)
                plain.append(t[at:])
        seen += characters(plain)
        kinds, kept = zip(*values, strict=True) if values else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(kept, pa.string()), pa.nulls(len(kept), pa.int32()), pa.nulls(len(kept), pa.int64())], names=names)
    pairs = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.string()), pa.array(pairs.astype(np.int32)), pa.array(seen.ravel()[pairs])], names=names)


def learn_from(docs: DataFrame, text: str = "text", train_values: int = TRAIN_VALUES) -> Format | None:
    rows = docs.select(F.col(text).alias("text"))
    found = held(rows.mapInArrow(lambda b: _labelled(b, "text"), "kind int, value string, pair int, n long").groupBy("kind", "value", "pair").agg(F.sum("n").alias("n")))
    values = {}
    for k, name in enumerate(KINDS):
        few = found.where(F.col("kind") == k).select("value").orderBy(F.xxhash64("value"), "value").limit(train_values)
        values[name] = [r["value"] for r in few.collect()]
    seen = np.zeros(_SIZE * _SIZE, np.int64)
    for r in found.where("pair is not null").select("pair", "n").collect():  # a row for each pair of symbols at most
        seen[r["pair"]] = r["n"]
    return learn(values, seen.reshape(_SIZE, _SIZE))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def all_spans(column: pa.Array, found: Format | None) -> list[list[tuple[int, int, int, str]]]:
    """(start, kind, end, secret) of each text, in code points, by start, then kind."""
    out = [base_spans(t) if t else [] for t in column.to_pylist()]
    if found is not None:
        data, at = flat(column)
        text, start, end = found.reported_runs(data, at)
        for row, a, b in sorted(zip(text.tolist(), start.tolist(), end.tolist(), strict=True)):
            if not out[row] or out[row][0][1] == len(KINDS):
                before = int(np.count_nonzero((data[at[row] : a] & 0xC0) != 0x80))
                out[row].append((before, len(KINDS), before + b - a, data[a:b].tobytes().decode("ascii")))
        for row, base in enumerate(out):
            if base and base[0][1] < len(KINDS):  # base spans cut candidates
                out[row] = sorted(base + format_spans(column[row].as_py(), base, found))
    return out


def find_secrets(docs: DataFrame, found: Format | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row: kind, start and end in code points, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    names = (*KINDS, FORMAT)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, text):
                out = [[{"kind": names[k], "start": a, "end": b} for a, k, b, _ in spans] for spans in all_spans(run.column(text), shared.value)]
                yield pa.RecordBatch.from_arrays([run.column(key), pa.array(out, _SPANS)], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(search, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, found: Format | None, text: str = "text", label: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the label in place of each secret."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    place = docs.columns.index(text)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(place).to_pylist(), all_spans(batch.column(place), shared.value), strict=True):
                if t:
                    parts, at = [], 0
                    for a, _, b, _ in spans:
                        if a >= at:
                            parts += [t[at:a], label]
                        at = max(at, b)
                    t = "".join(parts) + t[at:]
                out.append(t)
            columns = list(batch.columns)
            columns[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(change, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, learn_from(docs))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != FORMAT)
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == "assign")), F.size(F.filter("spans", lambda s: s["kind"] == "access")), F.size(F.filter("spans", lambda s: s["kind"] == "hex"))]
    return found.select(
        "doc_id",
        *[c.cast("long").alias(f"n_{k}") for k, c in zip(KINDS, counts, strict=True)],
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
