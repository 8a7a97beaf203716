"""Entities in texts by patterns, without a model: technologies, organisations and capitalised names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvasir.functions import text as t

# Technology families, organisation patterns, capitalised words that are no names, and words that tell a
# person (near a name) or a concept (in a name).
TECHNOLOGY = (
    r"(?i)\b(JavaScript|TypeScript|Python|Rust|Go|Java|Ruby|PHP|Swift|Kotlin|C\+\+|C#)\b",
    r"(?i)\b(React|Vue|Angular|Next\.js|Nuxt|Svelte|Express|FastAPI|Django|Flask|Spring|Rails)\b",
    r"(?i)\b(PostgreSQL|MySQL|MongoDB|Redis|SQLite|Elasticsearch|DynamoDB|Cassandra|Firebase)\b",
    r"(?i)\b(AWS|Azure|GCP|Kubernetes|Docker|Terraform|Jenkins|GitHub Actions|Vercel|Netlify)\b",
    r"(?i)\b(npm|yarn|pnpm|bun|pip|cargo|maven|gradle|webpack|vite)\b",
)
ORGANIZATION = (
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Inc|Corp|LLC|Ltd|Company|Technologies|Software|Labs|Studios)\b",
    r"\b(Google|Microsoft|Amazon|Apple|Meta|Facebook|Netflix|Uber|Airbnb|Stripe|OpenAI|Anthropic|GitHub|GitLab|Atlassian|Slack|Notion)\b",
)
CAPITALISED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"
COMMON = (
    "The", "This", "That", "These", "Those", "When", "Where", "What", "Which", "Who", "How", "Why", "Here", "There", "Some", "All", "Any", "Each", "Every", "Both", "Few", "More", "Most", "Other", "Such",
    "True", "False", "Null", "None", "Error", "Warning", "Info", "Debug", "Success", "Failed", "Todo", "Note", "Important",
    "Create", "Update", "Delete", "Read", "Write", "Add", "Remove", "Get", "Set", "Check", "Test", "Run", "Start", "Stop", "Build", "Deploy", "Install", "Configure", "Setup",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
PERSON = ("said", "wrote", "created", "developed", "founded", "led", "managed", "designed")
CONCEPT = ("pattern", "principle", "approach", "method", "strategy", "architecture", "design")


def guessed(name: Column, content: Column) -> Column:
    """PERSON by a word within 50 letters of the name's first place, CONCEPT by a word in the name, else OTHER."""
    low, text = F.lower(name), F.lower(content)
    at = F.instr(text, low)
    start = F.greatest(at - 50, F.lit(1))
    near = F.substring(text, start, at + F.length(low) + 50 - start)
    any_in = lambda words, x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    return F.when((at > 0) & any_in(PERSON, near), "PERSON").when(any_in(CONCEPT, low), "CONCEPT").otherwise("OTHER")


def matches(content: Column) -> Column:
    """array of (kind, name, confidence) by the families in their order; a name may come more than once.

    A capitalised name right after the end of a sentence (two letters behind a full stop, exclamation or question mark)
    doesn't count, nor does a common word, nor a name of less than four letters. Their kind is left open (null).
    """
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"(?i)^the\s+", "")
    entry = lambda kind, name, sure: F.struct(F.lit(kind).cast("string").alias("kind"), name.alias("name"), F.lit(sure).alias("confidence"))
    family = lambda p, kind, sure: F.transform(F.regexp_extract_all(content, F.lit(p), F.lit(1)), lambda x: entry(kind, tidy(x), sure))
    inner = F.regexp_replace(content, r"(?s)(?<=[.!?].)" + CAPITALISED, "\u0001")
    names = F.filter(F.regexp_extract_all(inner, F.lit(CAPITALISED), F.lit(1)), lambda x: ~x.isin(*COMMON) & (F.length(x) >= 4))
    return F.concat(*[family(p, "TECHNOLOGY", 0.6) for p in TECHNOLOGY], *[family(p, "ORGANIZATION", 0.5) for p in ORGANIZATION], F.transform(names, lambda x: entry(None, x, 0.3)))


def entities(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, kind, name, confidence): a text's entities, each name once, as it was found first. Null texts have none."""
    found = rows.select(key, content, F.posexplode(matches(F.col(content))).alias("nth", "m"))
    first = found.groupBy(key, F.lower("m.name").alias("low")).agg(F.min_by(F.struct("m.kind", "m.name", "m.confidence", F.when(F.col("m.kind").isNull(), guessed(F.col("m.name"), F.col(content))).alias("guess")), "nth").alias("f"))
    return first.select(key, F.coalesce("f.kind", "f.guess").alias("kind"), "f.name", "f.confidence")


def by_sentence(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sentence, kind, name, alias, confidence): a text's entities in each sentence that has their name."""
    known = entities(rows, key, content).withColumn("alias", t.entity_alias(F.col("name")))
    once = known.groupBy(key, "alias").agg(F.max_by(F.struct("kind", "name", "confidence"), F.struct("confidence", "name")).alias("e"))
    each = rows.select(key, F.posexplode(F.split(content, r"[.!?]\s+")).alias("sentence", "text"))
    # Names as they stand in the sentence; what begins one is known from the whole text.
    seen = each.select(key, "sentence", F.explode(F.array_distinct(F.transform(matches(F.col("text")), lambda m: m["name"]))).alias("name")).select(key, "sentence", t.entity_alias(F.col("name")).alias("alias")).distinct()
    return seen.join(once, [key, "alias"]).select(key, "sentence", "e.kind", "e.name", "alias", "e.confidence")
