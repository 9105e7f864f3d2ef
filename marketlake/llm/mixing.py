r"""Mixing documents to target weights by iterative proportional fitting.

Tokens (words `[^\x20\x09-\x0D]+`) are summed over cells of source, language
and topic.  The cell totals are raked: in turn, each dimension's totals are
scaled to its target shares, `rounds` times over, which gives the weights
nearest to the corpus that have all three marginals.  A cell's rate is its
raked share of the token budget over the tokens that it holds, and each of its
documents is drawn floor(rate + u) times, u being uniform and fixed by the id;
so the expected tokens of every marginal meet the target, and scarce cells are
repeated rather than cut.

Target shares are given as {value: share} for a dimension, or else follow from
the corpus as shares of tokens ** `alpha`, which lifts what is rare.  The topic
is that of the first phrase of `topics` in the text, or what a column says that
the caller names.

All of it is DataFrame functions.  Only cell totals are shuffled, summed before
in each task; raking is done on the table of cells by sums per value and joins.

Null source or language is the value '', a null topic of a column the last topic; null or empty text has the last topic
and no tokens.  Documents of cells without tokens are not drawn, nor are those
of a value whose target share is 0 or missing.  Rows that share an id share
their u.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.shared import held

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
TOPICS = (("licensed", "License"), ("tabular", " | "), ("contact", "@"), ("access", "token"), ("numeric", "+1 "))
REST = "prose"
ALPHA = 0.7
ROUNDS = 12
BUDGET = 1.0
SEED = "mix"


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS, rest: str = REST) -> Column:
    out = F.lit(rest)
    for name, phrase in reversed(topics):
        out = F.when(text.contains(phrase), F.lit(name)).otherwise(out)
    return out


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the id fixes."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _celled(docs: DataFrame, text: str, topics: tuple[tuple[str, str], ...], topic: str | None = None) -> DataFrame:
    named = topic_of(F.coalesce(F.col(text), F.lit("")), topics) if topic is None else F.coalesce(F.col(topic).cast("string"), F.lit(REST))
    return docs.withColumns({"__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__topic": named})


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, w): w are shares of the whole, raked to the targets.

    w is tokens times a factor for each dimension's value.  A step sets the factors of one dimension to
    goal / sum of tokens times the other two; only that table, a row per value, is written.
    """
    spark = cells.sparkSession
    base = held(cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double")))
    goals, factor = {}, {}
    for d in DIMENSIONS:
        if targets and d in targets:
            goal = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, goal double")
            goal = goal.join(base.select(d).distinct(), d, "left_semi")
        else:
            goal = base.groupBy(d).agg(F.pow(F.sum("w"), F.lit(alpha)).alias("goal"))
        goal = held(goal)
        whole = goal.agg(F.sum("goal").alias("all"))  # one row
        goals[d] = held(goal.join(F.broadcast(whole), how="cross").select(d, (F.col("goal") / F.col("all")).alias("goal")))
        factor[d] = goals[d].select(d, F.lit(1.0).alias(f"f_{d}"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            rows = base
            for other in DIMENSIONS:
                if other != d:
                    rows = rows.join(factor[other], other)
            part = rows.groupBy(d).agg(F.sum(F.col("w") * F.col("f_" + DIMENSIONS[DIMENSIONS.index(d) - 1]) * F.col("f_" + DIMENSIONS[DIMENSIONS.index(d) - 2])).alias("sum"))
            factor[d] = held(part.join(goals[d], d).select(d, (F.col("goal") / F.col("sum")).alias(f"f_{d}")))
    for d in DIMENSIONS:
        base = base.join(factor[d], d)
    return held(base.select(*DIMENSIONS, "tokens", (F.col("w") * F.col("f_source") * F.col("f_lang") * F.col("f_topic")).alias("w")))


def marginal_errors(raked: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(dimension, error): the largest difference between a raked share and its target, so that a caller can ask for more rounds."""
    out = None
    for d in DIMENSIONS:
        have = raked.groupBy(d).agg(F.sum("w").alias("w"), F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("goal"))
        if targets and d in targets:
            goal = raked.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, goal double")
            have = have.drop("goal").join(goal, d, "left").fillna(0.0, ["goal"])
        whole = have.agg(F.sum("goal").alias("all"))  # one row
        one = have.join(F.broadcast(whole), how="cross").agg(F.max(F.abs(F.col("w") - F.col("goal") / F.col("all"))).alias("error")).select(F.lit(d).alias("dimension"), "error")
        out = one if out is None else out.unionByName(one)
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, dict[str, float]] | None = None, topics: tuple[tuple[str, str], ...] = TOPICS, alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """The drawn documents with all their columns, and mix_topic, mix_rate and mix_copies (1 or more)."""
    kept = [c for c in docs.columns if c not in ("mix_topic", "mix_rate", "mix_copies")]
    rows = _celled(docs.select(kept), text, topics, topic)
    names = [F.col(f"__{d}").alias(d) for d in DIMENSIONS]
    cells = rows.groupBy(*names).agg(F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))).cast("long").alias("tokens"))
    raked = rake(cells, targets, alpha, rounds)
    total = raked.agg(F.sum("tokens").alias("all"), F.sum("w").alias("whole"))
    # Targets that sum to less than one leave that much of the budget out.
    rates = held(raked.join(total, how="cross").select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], (F.col("w") * F.lit(float(budget)) * F.col("all") / F.col("tokens")).alias("mix_rate")))
    drawn = rows.join(rates, [f"__{d}" for d in DIMENSIONS]).withColumn("mix_copies", F.floor(F.col("mix_rate") + uniform(F.col(key), seed)).cast("long"))
    return drawn.where("mix_copies >= 1").select(*kept, F.col("__topic").alias("mix_topic"), "mix_rate", "mix_copies")


def op5_mixing_by_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"))


def _sql() -> str:
    """The same in SQL, a common table expression for each step of raking."""
    case = "case " + " ".join(f"when contains(text, '{p}') then '{n}'" for n, p in TOPICS) + f" else '{REST}' end"
    steps = [
        f"docs as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, {case} as topic, text from (select doc_id, source, lang, coalesce(text, '') as text from documents))",
        rf"cells as (select source, lang, topic, sum(len(regexp_extract_all(text, '{WORD}'))) as tokens from docs group by all)",
        "r0 as (select source, lang, topic, tokens, cast(tokens as double) as w from cells where tokens > 0)",
    ]
    for d in DIMENSIONS:
        steps.append(f"g_{d} as (select {d}, pow(sum(w), {ALPHA}) / sum(pow(sum(w), {ALPHA})) over () as goal from r0 group by {d})")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"r{n + 1} as materialized (select r.source, r.lang, r.topic, r.tokens, r.w * g.goal / sum(r.w) over (partition by r.{d}) as w from r{n} r join g_{d} g using ({d}))")
            n += 1
    steps.append(f"rates as (select source, lang, topic, w * {BUDGET} * sum(tokens) over () / tokens as rate from r{n})")
    u = f"cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0"
    return "with " + ",\n".join(steps) + f"\nselect doc_id, source, lang, topic, round(rate, 6) as rate, cast(floor(rate + {u}) as bigint) as copies from docs join rates using (source, lang, topic) where floor(rate + {u}) >= 1"


OP5_SQL = _sql()
