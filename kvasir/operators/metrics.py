"""Percentiles by index, latency summaries, ownership, bus factor and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins a group's distinct values are divided into.
CUTS = 64


def _at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, _n, one column a name): the group's values at the named ranks, each an expression of the group's number of rows _n.

    Values are counted first. Cuts between each group's distinct values divide them into bins; only the bins that hold a
    wanted rank are sorted, so no task sorts a whole group, however hot. The cuts are approximate, the values exact.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    share = [i / CUTS for i in range(1, CUTS)]
    groups = counts.groupBy(*by).agg(F.sum("_m").alias("_n"), F.coalesce(F.percentile_approx("_v", share), F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")).alias("_cuts"))
    groups = groups.withColumn("_want", F.array(*[r.cast("long") for r in ranks.values()]))
    met = groups.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_n", "_cuts", "_want")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    binned = counts.join(met, same).withColumn("_bin", F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))).drop("_cuts")
    sizes = binned.groupBy(*by, "_bin").agg(F.sum("_m").alias("_held"), F.first("_want").alias("_w"))
    sizes = sizes.withColumn("_upto", F.sum("_held").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = sizes.where(F.exists("_w", lambda k: (k <= F.col("_upto")) & (k > F.col("_upto") - F.col("_held"))))
    wanted = wanted.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_bin").alias("_b"), (F.col("_upto") - F.col("_held")).alias("_before"))
    inside = binned.drop(*[f"_{i}" for i in range(len(by))]).join(wanted, [*same, F.col("_bin") == F.col("_b")])
    last = F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_last", last)
    at = lambda i: F.max(F.when((F.col("_want")[i] <= F.col("_last")) & (F.col("_want")[i] > F.col("_last") - F.col("_m")), F.col("_v")))
    return inside.groupBy(*by).agg(F.max("_n").alias("_n"), *[at(i).alias(name) for i, name in enumerate(ranks)])


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Per group: the value at rank max(1, ceil(p / 100 * n)) for each named percentile."""
    at = {name: F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * F.col("_n"))) for name, p in percents.items()}
    return _at_ranks(df, by, value, at).drop("_n")


def quantile_sorted(df: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Per group, with i = n * p: value ceil(i) if i is no integer, else the mean of values i and i + 1 if n is even, else value i + 1."""
    ranks, place = {}, {name: F.round(F.col("_n") * F.lit(p), 9) for name, p in percents.items()}
    for name, i in place.items():
        ranks |= {f"{name}_low": F.least(F.col("_n"), F.ceil(i)), f"{name}_here": F.greatest(F.lit(1), F.floor(i)), f"{name}_up": F.least(F.col("_n"), F.floor(i) + 1)}
    found = _at_ranks(df, by, value, ranks)
    picked = lambda name, i: F.when(i != F.floor(i), F.col(f"{name}_low")).when(F.col("_n") % 2 == 0, (F.col(f"{name}_here") + F.col(f"{name}_up")) / 2.0).otherwise(F.col(f"{name}_up"))
    return found.select(*by, *[picked(name, i).alias(name) for name, i in place.items()])


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, max, avg and p50, p95, p99 by nearest rank, all rounded to 2 places."""
    basic = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    p = nearest_rank(df, by, value, {"p50": 50, "p95": 95, "p99": 99})
    out = basic.join(p, by) if by else basic.crossJoin(p)  # one row each
    return out.select(*by, *[F.round(c, 2).alias(c) for c in ("min", "max", "avg", "p50", "p95", "p99")])


def js_round(x: Column) -> Column:
    """Half up, as floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def expertise(commits: DataFrame) -> DataFrame:
    """(dir, author_email, touches, last_commit, pct, rank) of commit-file touches per directory."""
    g = commits.groupBy("dir", "author_email").agg(F.count(F.lit(1)).alias("touches"), F.max("ts_s").alias("last_commit"))
    pct = js_round(100.0 * F.col("touches") / F.sum("touches").over(Window.partitionBy("dir")))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("touches"), "author_email"))
    return g.withColumn("pct", pct).withColumn("rank", rank.cast("long"))


def bus_factor(experts: DataFrame, least_pct: int = 5, risk_pct: int = 80) -> DataFrame:
    """(dir, bus_factor, top_pct, risky, last_commit)."""
    g = experts.groupBy("dir").agg(F.count_if(F.col("pct") >= least_pct).alias("n"), F.max("pct").alias("top_pct"), F.max("last_commit").alias("last_commit"))
    return g.select("dir", F.greatest(F.lit(1).cast("long"), F.col("n")).alias("bus_factor"), "top_pct", (F.col("top_pct") >= risk_pct).alias("risky"), "last_commit")


def health(entries: DataFrame, stale_before: int) -> DataFrame:
    """(health, dirs, risky, stale, avg_bus_factor) of the directories; 100 without any."""
    g = entries.agg(
        F.count(F.lit(1)).alias("dirs"), F.count_if("risky").alias("risky"), F.count_if(F.col("last_commit") < stale_before).alias("stale"), F.avg("bus_factor").alias("bf")
    )
    score = 100.0 - F.least(F.lit(30.0), 50.0 * F.col("risky") / F.col("dirs")) - F.least(F.lit(20.0), 30.0 * F.col("stale") / F.col("dirs"))
    score = F.when(F.col("bf") < 3, score - (3 - F.col("bf")) * 15).otherwise(F.least(F.lit(100.0), score + 10))
    return g.select(F.when(F.col("dirs") == 0, F.lit(100).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), js_round(score))).alias("health"), "dirs", "risky", "stale", F.round("bf", 6).alias("avg_bus_factor"))


def ownership(commits: DataFrame, excluded: list[str], recent_after: int) -> DataFrame:
    """(file, author_email, commits, pct, recent, last_commit); excluded authors leave before shares are taken."""
    c = commits.where(~F.col("author_email").isin(*excluded)) if excluded else commits
    g = c.groupBy("file", "author_email").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("ts_s") >= recent_after).alias("recent"), F.max("ts_s").alias("last_commit"))
    return g.withColumn("pct", js_round(100.0 * F.col("commits") / F.sum("commits").over(Window.partitionBy("file"))))


def reviewers(owned: DataFrame, files: DataFrame, limit: int = 5) -> DataFrame:
    """Authors of the changed ``files`` (file): expertise_pct, relevance, category and rank, at most ``limit``, half of them required."""
    o = owned.join(files, "file")
    n = files.agg(F.count(F.lit(1)).alias("total"))
    g = o.groupBy("author_email").agg(F.avg("pct").alias("own"), F.count(F.lit(1)).alias("held"), F.sum("recent").alias("recent")).crossJoin(n)  # one row
    g = g.withColumn("coverage", F.col("held") / F.col("total")).withColumn("expertise_pct", js_round(F.col("own") * F.col("coverage")))
    relevance = 0.7 * F.col("coverage") + 0.3 * F.col("own") / 100.0 + F.when(F.col("recent") > 0, 0.1).otherwise(0.0)
    g = g.withColumn("relevance", F.round(relevance, 6)).withColumn("category", F.when((F.col("own") >= 50) & (F.col("coverage") > 0.3), "required").otherwise("optional"))
    order = [F.desc("expertise_pct"), F.desc("relevance"), F.asc("author_email")]
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    half = -(-limit // 2)
    return g.where(F.when(F.col("category") == "required", F.col("place") <= half).otherwise(F.col("place") <= limit)).select("author_email", "expertise_pct", "relevance", "category")


def pr_summary(commits: DataFrame, key: str, message: str, files: str) -> DataFrame:
    """(key, summary): what each pull request does by the types of its commits, or how much it touches.

    Only counts are kept of a request, however many commits it has.
    """
    kind = F.lower(F.regexp_extract(message, r"(?i)^(feat|fix|docs|style|refactor|test|chore)(?:\((.+)\))?:", 1))
    told = ("feat", "fix", "refactor", "docs", "test")
    g = commits.withColumn("_kind", kind).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(files).alias("files"), *[F.sum((F.col("_kind") == k).cast("int")).alias(k) for k in told])
    say = lambda k, before, after: F.when(F.col(k) > 0, F.concat(F.lit(before), F.col(k).cast("string"), F.lit(after)))
    parts = F.concat_ws(
        ". ", say("feat", "Adds ", " new feature(s)"), say("fix", "Fixes ", " bug(s)"), say("refactor", "Refactors ", " component(s)"), F.when(F.col("docs") > 0, "Updates documentation"), F.when(F.col("test") > 0, "Adds/updates tests")
    )
    other = F.concat(F.lit("This PR includes "), F.col("n").cast("string"), F.lit(" commit(s) affecting "), F.col("files").cast("string"), F.lit(" file(s)."))
    return g.select(key, F.when(parts == "", other).otherwise(F.concat(parts, F.lit("."))).alias("summary"))
