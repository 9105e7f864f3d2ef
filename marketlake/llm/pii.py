r"""Personal data by patterns, and by what the corpus says about the words beside it.

Base spans are emails, IP addresses, card numbers and phone numbers, leftmost
and non-overlapping for each kind, in code points.  The patterns are the stated
ones with possessive repeats and start conditions that change no match but let
long runs be read once, without recursion.

The method adds spans (kind `term`): the information-theoretic view that a word
discloses a protected entity when the two share most of their information.  For
a word t in the same text as an entity e,

    PMI(t; e) = log(n(t,e) N / (n(t) n(e)))     IC(e) = log(N / n(e))

over distinct texts, so that exact copies count once in all four: n(t) counts the
texts of the whole corpus that hold t, N all texts.  PMI / IC is 1 when t occurs only with e.  With a ratio of
`disclosure` or more, and `support` texts that hold both and differ in the `WINDOW`
characters around e (so that near copies count once), every occurrence of t in documents that hold e is a
span.  `sanitise` puts a label for its kind in place of a base span, which
generalises it, and removes terms down to `[TERM]`.  Words are runs of letters of any length; one of
fewer than `LETTERS` letters is a term only if some text with an entity writes it
without a small first letter, as names are (Ann, Li).

All of it is DataFrame functions.  Documents without base spans never leave
their task; what is shuffled are entities, words beside them, and pre-aggregated
counts of those words.

Null texts count as empty and have no spans.  Rows that share an id are judged
each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import held

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 60
SUPPORT = 3
DISCLOSURE = 0.95
LETTERS = 4

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_SPAN = "struct<kind:int,start:int,end:int,value:string,beside:string>"


def _luhn(digits: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + one(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def placed(text: str, pattern: Column | str, matches: str, kind: int, beside: int = 0) -> Column:
    """Spans of the matches of a pattern: lengths of what lies between them, summed up."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.arrays_zip(F.split(F.col(text), regex, -1).alias("gap"), F.col(matches).alias("hit"))
    parts = F.filter(parts, lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        near = F.concat_ws(" ", F.substring(F.col(text), F.greatest(start - beside + 1, F.lit(1)), F.least(start, F.lit(beside))), F.substring(F.col(text), end + 1, F.lit(beside))) if beside else F.lit("")
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"), near.alias("beside"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span).cast(f"array<{_SPAN}>")).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    found = F.aggregate(parts, none, lambda a, x: step(a, x).cast(f"struct<at:int,out:array<{_SPAN}>>"), lambda a: a["out"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base_spans", beside: int = WINDOW) -> DataFrame:
    """A further column: base spans by kind, then start."""
    keep = [c for c in docs.columns if c != out]
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    hits = {k: F.when(F.col("__text").contains(NEEDS[k]) if k in NEEDS else F.col("__text").rlike("[0-9]"), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()}
    df = df.withColumns({f"__{k}": c for k, c in hits.items()})
    spans = [F.filter(placed("__text", p, f"__{k}", i, beside), _checked(k)) for i, (k, p) in enumerate(PATTERNS.items())]
    return df.withColumn(out, F.concat(*spans)).select(*keep, out)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def _of_kind(number: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == number


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def _terms(text: Column) -> Column:
    return F.array_distinct(_words(F.lower(text)))


def disclosing(found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(kind, value, term): words that disclose an entity, by co-occurrence over the whole corpus.

    `found` has `row`, `__text` and `base_spans` of the distinct texts that have any; `texts` has `row` and `__text` of all.
    """
    # One surrounding for each text and entity, so that `support` counts texts.
    entity = held(found.select("row", F.explode("base_spans").alias("s")).groupBy("row", "s.kind", "s.value").agg(F.min(F.xxhash64("s.beside")).alias("ctx")))
    total = texts.agg(F.count_distinct("row").alias("n"))  # one row
    # The ratio is high enough exactly if n(t) is at most n(t,e) times this.
    times = F.pow(F.col("n") / F.col("n_e"), F.lit(1 - disclosure))
    n_entity = entity.groupBy("kind", "value").agg(F.count("*").alias("n_e"), F.count_distinct("ctx").alias("n_all")).where(f"n_all >= {support}").drop("n_all")
    n_entity = held(n_entity.crossJoin(F.broadcast(total)).where("n > n_e").withColumn("times", times))
    most = n_entity.agg(F.max(F.col("n_e") * F.col("times")).alias("limit"))  # one row
    # Words in too few texts with entities, or in too many, can be terms of no entity.
    short = found.select(F.explode(F.array_distinct(F.filter(_words(F.col("__text")), lambda w: (F.length(w) < LETTERS) & w.rlike(r"^\P{Ll}")))).alias("w")).select(F.lower("w").alias("term"), F.lit(True).alias("named")).distinct()
    near = found.select(F.explode(_terms(F.col("__text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    near = near.where(f"n_near >= {support}").crossJoin(F.broadcast(most)).where("n_near <= limit").drop("limit")
    near = held(near.join(short, "term", "left").where(f"length(term) >= {LETTERS} or named").drop("named"))
    terms = found.select("row", F.explode(_terms(F.col("__text"))).alias("term")).join(near, "term")
    pair = entity.join(n_entity, ["kind", "value"]).join(terms, "row").where("n_near <= n_e * times")
    pair = pair.groupBy("kind", "value", "term").agg(F.count("*").alias("n_te"), F.count_distinct("ctx").alias("n_ctx"), F.first("n_near").alias("n_near"), F.first("times").alias("times"))
    pair = pair.where((F.col("n_ctx") >= support) & (F.col("n_near") <= F.col("n_te") * F.col("times")) & ~F.array_contains(_terms(F.col("value")), F.col("term")))
    pair = held(pair.select("kind", "value", "term", (F.col("n_te") * F.col("times")).alias("most")))
    wanted = pair.select("term").distinct()
    n_term = texts.select("row", F.explode(_terms(F.col("__text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count_distinct("row").alias("n_t"))
    return pair.join(n_term, "term").where("n_t <= most").select("kind", "value", "term")


def find_spans(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(all rows with base_spans, rows with term_spans by `row`); `row` names a text by its hash."""
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1))
    rows = with_base_spans(docs, text).withColumn("row", own)
    some = held(rows.where(F.size("base_spans") > 0).select("row", F.col(text).alias("__text"), "base_spans").dropDuplicates(["row"]))
    texts = docs.select(own.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    pairs = held(disclosing(some, texts, support, disclosure))
    entity = some.select("row", F.explode("base_spans").alias("s")).select("row", "s.kind", "s.value").distinct()
    words = entity.join(pairs, ["kind", "value"]).groupBy("row").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    marked = some.join(words, "row").withColumn("__p", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})")))
    marked = marked.withColumn("__m", F.regexp_extract_all("__text", F.col("__p"), F.lit(0)))
    return rows, held(marked.select("row", placed("__text", F.col("__p"), "__m", len(KINDS)).alias("term_spans")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Counts and spans of every row."""
    rows, terms = find_spans(docs.select(key, text), text, **options)
    base = F.col("base_spans")
    slim = rows.select(key, "row", F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base_spans"))
    more = F.transform("term_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    all_ = slim.join(terms, "row", "left").withColumn("more", F.coalesce(more, F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    counts = [F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return all_.select(key, *counts, F.size("more").cast("long").alias("n_term"), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.concat(base, "more")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows and columns, with labels in place of the spans in the text."""
    names = [c for c in docs.columns]
    plain = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)])
    body = f"__c{names.index(text)}"
    rows, terms = find_spans(plain, body, **options)
    clean = rows.where(F.size("base_spans") == 0)
    dirty = rows.where(F.size("base_spans") > 0).join(terms, "row", "left")
    spans = F.array_sort(F.transform(F.concat("base_spans", F.coalesce("term_spans", F.array().cast(f"array<{_SPAN}>"))), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])

    def step(acc: Column, s: Column) -> Column:
        # A span inside what an earlier one covers goes with it; one that runs further only extends it.
        end = F.greatest(acc["at"], -s["back"])
        gap = F.substring(F.col(body), acc["at"] + 1, s["start"] - acc["at"])
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.get(labels, s["kind"]))).otherwise(acc["out"])
        return F.struct(end.alias("at"), put.alias("out")).cast("struct<at:int,out:string>")

    rest = lambda a: F.concat(a["out"], F.substring(F.col(body), a["at"] + 1, F.length(body)))
    changed = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    dirty = dirty.withColumn("spans", spans).withColumn(body, changed)
    columns = [f"__c{i}" for i in range(len(names))]
    return clean.select(columns).unionByName(dirty.select(columns)).toDF(*names)


def op4_information_theoretic_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
