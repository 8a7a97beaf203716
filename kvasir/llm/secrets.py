"""Operator 4: secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found with fixed patterns; each one's value is hashed, and hashes are aggregated over the
corpus by distinct repositories and owners. A value seen in ``min_owners`` repositories and under as many owners
is a widely copied example, and so is one that says of itself that it is none (``PLACEHOLDER``); any other is
owner-specific and looks live. Repositories are owners' own: two of one name under two owners are two. Both are
counted from distinct pairs, combined on the map side, so a value in a third of all rows reaches a task only as
its distinct pairs.

Positions come from splitting a text by the pattern: the n-th match starts after the first n pieces and
n - 1 matches. They are code points, ends exclusive; a span is the whole match.

Defined cases: null text counts as empty and has no spans; null repositories or owners count as one value
each; repeated rows each get a row; a text of any length is scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvasir.llm.common import Stage, whole

# Kind, pattern, number of the group that is the value, least length of the value.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"sk_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
#: A literal that every match of the kind holds, where there is one; it spares most texts the pattern.
LITERAL = {"access": "AKIA", "github": "_", "slack": "xox", "stripe": "sk_live_", "jwt": "eyJ", "pem": "PRIVATE KEY"}
BASE = ("assign", "access", "hex")
#: What a value holds that is an example by its own words.
PLACEHOLDER = r"(?i)example|placeholder|change_?me|your_?|dummy|sample|x{4}|\*{4}|0{8}"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: Column, rank: int) -> Column:
    """The kind's matches that are long enough, as structs in order of their start."""
    kind, pattern, group, least = PATTERNS[rank]
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    step = F.arrays_zip(pieces.alias("gap"), found.alias("hit"), values.alias("value"))
    none = F.array().cast(SPAN)
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(step, begin, add)["out"]
    may = text.rlike(pattern)
    if kind in LITERAL:
        may = F.contains(text, F.lit(LITERAL[kind])) & may
    return F.when(may, spans).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and spans: array of (start, rank, kind, end, value), by start and then kind."""
    text = whole(F.col(text_col))
    spans = F.array_sort(F.concat(*[_spans(text, k) for k in range(len(PATTERNS))]))
    return docs.select(*[F.col(c) for c in keep or docs.columns], spans.alias("spans"))


COUNTS = ("n_copied", "n_live", "most_repos", "most_owners")


def ownership(candidates: DataFrame, min_owners: int = 3) -> DataFrame:
    """For each value_hash of (value_hash, placeholder, repo, owner): n_repos, n_owners (long), copied (boolean)."""
    pairs = candidates.select("value_hash", "placeholder", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    owners = pairs.groupBy("value_hash", "placeholder", "owner").agg(F.count(F.lit(1)).alias("repos"))
    seen = owners.groupBy("value_hash", "placeholder").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    return seen.withColumn("copied", F.col("placeholder") | (F.least("n_repos", "n_owners") >= min_owners)).drop("placeholder")


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column, min_owners: int = 3) -> DataFrame:
    """One row per document: id, spans (see find_spans), n_copied and n_live: its spans by kind of value, and most_repos
    and most_owners: of its live values the most repositories and owners one has (all long, 0 without)."""
    stage = Stage(docs.sparkSession, "secrets")
    found = stage.table(
        find_spans(
            docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner")),
            keep=["id", "repo", "owner"],
        ).withColumn("row", F.monotonically_increasing_id())
    )
    each = found.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("span"))
    each = each.select("row", "repo", "owner", F.sha2(F.col("span.value"), 256).alias("value_hash"), F.col("span.value").rlike(PLACEHOLDER).alias("placeholder"))
    known = stage.table(ownership(each, min_owners))
    live = ~F.col("copied")
    counts = each.drop("repo", "owner").join(known, "value_hash").groupBy("row").agg(
        F.count_if("copied").alias("n_copied"), F.count_if(live).alias("n_live"), F.max(F.when(live, F.col("n_repos"))).alias("most_repos"), F.max(F.when(live, F.col("n_owners"))).alias("most_owners")
    )
    return found.join(counts, "row", "left").select(F.col("id").alias(id_col), "spans", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns, derived from the operator's spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select(
        id_col, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *COUNTS,
    )


def _duck_kind(rank: int) -> str:
    kind, pattern, group, least = PATTERNS[rank]
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, repo, owner, {rank} AS rank, '{kind}' AS kind,
  CAST(coalesce(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
  length(regexp_extract_all(t, '{p}')[i]) AS n, regexp_extract_all(t, '{p}', {group})[i] AS v
FROM (SELECT *, unnest(generate_series(1, len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{p}')) WHERE length(regexp_extract_all(t, '{p}', {group})[i]) >= {least}"""


#: The query over documents in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source || '/' || lang AS repo, source AS owner FROM documents),
f AS ({" UNION ALL ".join(_duck_kind(k) for k in range(len(PATTERNS)))}),
w AS (SELECT v, count(DISTINCT (coalesce(repo, ''), coalesce(owner, ''))) AS repos, count(DISTINCT coalesce(owner, '')) AS owners,
  regexp_matches(v, '{PLACEHOLDER}') OR least(repos, owners) >= 3 AS copied FROM f GROUP BY v),
a AS (SELECT f.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(CASE WHEN rank < 3 THEN kind || ':' || s || ':' || (s + n) END, ',' ORDER BY s, rank) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans,
  count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live, max(repos) FILTER (NOT copied) AS most_repos, max(owners) FILTER (NOT copied) AS most_owners FROM f JOIN w USING (v) GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live,
  coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners
FROM d LEFT JOIN a USING (doc_id)
"""
