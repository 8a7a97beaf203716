"""Tags by a taxonomy, and the technology stack of projects, by joins with dictionary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvasir.functions import text as t
from kvasir.functions.dictionaries import APP_ROUTER, CONFIGURED, RUNTIME, STACK, TAXONOMY
from kvasir.operators.relational import dice_join


def taxonomy(spark: SparkSession, tags: list = TAXONOMY) -> DataFrame:
    """(nth, canonical, aliases, category, parent); custom tags are further rows."""
    return spark.createDataFrame([(n, c, list(al), k, p) for n, (c, al, k, p) in enumerate(tags)], "nth int, canonical string, aliases array<string>, category string, parent string")


def names(tags: DataFrame) -> DataFrame:
    """(name, canonical): canonical names and aliases; a name that two tags have is the later one's, as in an index built in order."""
    each = tags.select("nth", "canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("name"))
    return each.groupBy("name").agg(F.max_by("canonical", "nth").alias("canonical"))


def normalise(rows: DataFrame, tag: str, tags: DataFrame, strict: bool = False) -> DataFrame:
    """The rows with ``canonical``: a tag's canonical name by any alias, else its slug, or in strict mode null.

    The dictionary is a table: small ones are broadcast by their size, large ones joined. Null and blank tags have none.
    """
    low = F.lower(F.trim(F.col(tag)))
    known = names(tags).select(F.col("name").alias("_low"), F.col("canonical").alias("_known"))
    out = rows.withColumn("_low", F.when(low != "", low)).join(known, "_low", "left")
    other = F.lit(None).cast("string") if strict else t.slug(F.col("_low"))
    return out.withColumn("canonical", F.coalesce("_known", other)).drop("_low", "_known")


def normalise_list(rows: DataFrame, key: str, array: str, tags: DataFrame, strict: bool = False) -> DataFrame:
    """(key, tags): each row's distinct canonical tags in the order of their first places."""
    each = normalise(rows.select(key, F.posexplode(array).alias("at", "tag")), "tag", tags, strict).where("canonical IS NOT NULL AND canonical <> ''")
    first = each.groupBy(key, "canonical").agg(F.min("at").alias("at"))
    found = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical"))), lambda s: s["canonical"]).alias("tags"))  # a row's
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def suggest(queries: DataFrame, query: str, tags: DataFrame, limit: int = 10, least: float = 0.3) -> DataFrame:
    """(query, canonical, score, rank): exact names score 1, aliases .99, similar names their likeness, similar aliases .95 of it.

    A canonical name's own likeness goes before its aliases', if it is enough. Ties go by the taxonomy's order.
    """
    q = queries.select(F.lower(F.trim(F.col(query))).alias("q")).where("q <> ''").distinct()
    forms = tags.select("canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("form")).select("canonical", F.lower("form").alias("form"))
    near = dice_join(q.withColumn("name", F.col("q")), forms.select(F.col("form").alias("q"), F.col("form").alias("name")).distinct(), "q", "name", least)
    met = near.select(F.col("a").alias("q"), F.col("b").alias("form"), F.col("dice")).join(forms, "form")
    own, equal = F.col("form") == F.col("canonical"), F.col("form") == F.col("q")
    best = met.groupBy("q", "canonical").agg(
        F.max(F.when(equal & own, 1.0)).alias("exact"), F.max(F.when(equal & ~own, 0.99)).alias("alias"), F.max(F.when(own, F.col("dice"))).alias("near"), F.max(F.when(~own, F.col("dice"))).alias("near_alias")
    )
    scored = best.withColumn("score", F.coalesce("exact", "alias", "near", F.col("near_alias") * 0.95)).join(tags.select("canonical", "nth"), "canonical")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "nth"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("q").alias(query), "canonical", "score", F.col("rank").cast("long").alias("rank"))


def stack(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(project, part, name): framework, database, auth, testing and runtime of projects by their dependencies
    (project, dep) and files (project, path)."""
    spark = dependencies.sparkSession
    rules = spark.createDataFrame([(n, part, name, dep) for n, (part, name, deps) in enumerate(STACK) for dep in deps], "nth int, part string, name string, dep string")
    first = dependencies.join(F.broadcast(rules), "dep").groupBy("project", "part").agg(F.min_by("name", "nth").alias("name"))  # 60 rules
    told = _told(files)
    out = first.join(told, "project", "left")
    name = F.when(F.col("name") == "Next.js", F.when(F.coalesce("router", F.lit(False)), "Next.js (App Router)").otherwise("Next.js (Pages Router)"))
    for n, _ in CONFIGURED:
        name = name.when((F.col("name") == n) & F.coalesce(f"has_{n}", F.lit(False)), F.lit(f"{n} (configured)"))
    runtime = told.where("runtime IS NOT NULL").select("project", F.lit("runtime").alias("part"), F.col("runtime").alias("name"))
    return out.select("project", "part", name.otherwise(F.col("name")).alias("name")).union(runtime)


def _told(files: DataFrame) -> DataFrame:
    """(project, router, has_..., runtime): what its files tell of each project."""
    nth = F.coalesce(*[F.when(F.col("path") == p, F.lit(n)) for n, (p, _) in enumerate(RUNTIME)])
    runtime = F.coalesce(*[F.when(F.col("first") == n, F.lit(name)) for n, (_, name) in enumerate(RUNTIME)])
    out = files.withColumn("nth", nth).groupBy("project").agg(F.max(F.col("path").isin(*APP_ROUTER)).alias("router"), *[F.max(F.col("path") == p).alias(f"has_{n}") for n, p in CONFIGURED], F.min("nth").alias("first"))
    return out.withColumn("runtime", runtime).drop("first")
