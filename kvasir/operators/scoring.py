"""Relevance factors, decay, boost rules and staleness, as column expressions over memories.

Times are epoch seconds; ``now`` is a parameter, so results never depend on the clock.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0
LN2 = 0.6931471805599453


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def semantic_score(raw: Column) -> Column:
    return F.when(_finite(raw), clamp(raw)).otherwise(0.0)


def age_days(created: Column, accessed: Column, now: int) -> Column:
    return F.greatest(F.lit(0), F.lit(now) - F.greatest(created, accessed)) / DAY


def recency_exponential(days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-days * (LN2 / half_life)) if half_life > 0 else F.lit(0.0)


def recency_linear(days: Column, full_decay: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - days / full_decay)


def recency_step(days: Column, thresholds: list[tuple[float, float]]) -> Column:
    """1 below the first threshold, else the score of the largest threshold reached."""
    steps = sorted(thresholds)
    if not steps:
        return F.lit(0.0)
    out = F.when(days < steps[0][0], 1.0)
    for i in range(1, len(steps)):
        out = out.when(days < steps[i][0], steps[i - 1][1])
    return out.otherwise(steps[-1][1])


def frequency_log(count: Column, top: int = 100, cold_start: float = 0.5) -> Column:
    return F.when(count > 0, F.least(F.lit(1.0), F.log(count + 1.0) / F.log(F.lit(top + 1.0)))).otherwise(cold_start)


def frequency_linear(count: Column, top: int = 100, cold_start: float = 0.5) -> Column:
    return F.when(count > 0, F.least(F.lit(1.0), count / float(top))).otherwise(cold_start)


def frequency_sigmoid(count: Column, top: int = 100, cold_start: float = 0.5) -> Column:
    """A logistic curve centred on half of ``top``, shifted and scaled to run from 0 to 1."""
    low = F.lit(1.0) / (1.0 + F.exp(F.lit(3.0)))
    curve = 1.0 / (1.0 + F.exp(-(count - top / 2.0) / (top / 6.0)))
    return F.when(count > 0, clamp((curve - low) / (1.0 - 2.0 * low))).otherwise(cold_start)


def confidence_score(importance: Column) -> Column:
    return F.when(_finite(importance), clamp(importance)).otherwise(0.5)


@dataclass(frozen=True)
class Decay:
    """Confidence-decay settings; a memory's own decay_rate scales the half life."""

    function: str = "exponential"
    half_life: float = 90.0
    floor: float = 0.1
    refresh_on_access: bool = True
    exempt_types: tuple[str, ...] = ("architecture", "decision")
    exempt_tags: tuple[str, ...] = ("pinned", "permanent")
    full_decay: float = 365.0
    steps: tuple[tuple[float, float], ...] = ((30, 0.9), (90, 0.7), (180, 0.5))


def decayed_confidence(c: Decay, now: int) -> Column:
    """Over the columns type, tags, importance, created_at, accessed_at, decay_rate and last_refreshed_at."""
    base = confidence_score(F.col("importance"))
    rate = F.coalesce("decay_rate", F.lit(1.0))
    tagged = F.exists("tags", lambda t: F.lower(t).isin([x.lower() for x in c.exempt_tags]))
    exempt = (rate == 0) | F.col("type").isin(*c.exempt_types) | tagged
    seen = F.greatest("accessed_at", "created_at") if c.refresh_on_access else F.col("created_at")
    days = F.greatest(F.lit(0), F.lit(now) - F.coalesce("last_refreshed_at", seen)) / DAY * rate
    if c.function == "none":
        return base
    factor = {"exponential": lambda: recency_exponential(days, c.half_life), "linear": lambda: recency_linear(days, c.full_decay), "step": lambda: recency_step(days, list(c.steps))}[c.function]()
    return F.when(exempt, base).otherwise(F.least(base, F.greatest(F.lit(c.floor), base * factor)))


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.5
    recency: float = 0.2
    confidence: float = 0.15
    frequency: float = 0.15

    def normalised(self) -> Weights:
        w = (self.semantic, self.recency, self.confidence, self.frequency)
        total = sum(w)
        if total == 0:
            return Weights(0.25, 0.25, 0.25, 0.25)
        return self if abs(total - 1) < 0.001 else Weights(*[x / total for x in w])


# The named weight presets (semantic, recency, confidence, frequency).
PRESETS = {
    "balanced": Weights(0.5, 0.2, 0.15, 0.15),
    "semantic": Weights(0.8, 0.1, 0.05, 0.05),
    "recency": Weights(0.3, 0.5, 0.1, 0.1),
    "frequency": Weights(0.3, 0.15, 0.15, 0.4),
    "architecture": Weights(0.4, 0.1, 0.4, 0.1),
}


@dataclass(frozen=True)
class Boost:
    """kind: recency, importance, frequency, staleness, memory_type or tags; value: the bound or the values."""

    name: str
    kind: str
    value: object
    factor: float
    match_all: bool = False


def _holds(b: Boost, now: int) -> Column:
    days = age_days(F.col("created_at"), F.col("accessed_at"), now)
    if b.kind == "recency":
        return days <= b.value
    if b.kind == "staleness":
        return days >= b.value
    if b.kind == "importance":
        return F.col("importance") >= b.value
    if b.kind == "frequency":
        return F.col("access_count") >= b.value
    if b.kind == "memory_type":
        return F.col("type").isin(*b.value)
    if b.kind == "tags":
        has = [F.array_contains(F.transform("tags", F.lower), v.lower()) for v in b.value]
        out = has[0]
        for h in has[1:]:
            out = out & h if b.match_all else out | h
        return out
    raise ValueError(f"no boost rule of kind {b.kind}")


def boosted(raw: Column, rules: list[Boost], now: int) -> tuple[Column, Column]:
    """(score, names of the rules applied). With a rule applied, the product is clamped to 0..2; else it is the raw score."""
    factor, names = F.lit(1.0), []
    for b in rules:
        factor = factor * F.when(_holds(b, now), b.factor).otherwise(1.0)
        names.append(F.when(_holds(b, now), F.lit(b.name)))
    applied = F.filter(F.array(*names), lambda n: n.isNotNull()) if names else F.array().cast("array<string>")
    return F.when(F.size(applied) > 0, clamp(raw * factor, 0.0, 2.0)).otherwise(raw), applied


@dataclass(frozen=True)
class Config:
    weights: Weights = field(default_factory=Weights)
    half_life: float = 30.0
    frequency_top: int = 100
    boosts: tuple[Boost, ...] = ()


def score(hits: DataFrame, now: int, config: Config = Config()) -> DataFrame:
    """Adds the factors, raw_score, final_score and boosts to memories with a column ``similarity``."""
    w = config.weights.normalised()
    out = (
        hits.withColumn("f_semantic", semantic_score(F.col("similarity")))
        .withColumn("f_recency", recency_exponential(age_days(F.col("created_at"), F.col("accessed_at"), now), config.half_life))
        .withColumn("f_confidence", confidence_score(F.col("importance")))
        .withColumn("f_frequency", frequency_log(F.col("access_count"), config.frequency_top))
    )
    raw = w.semantic * F.col("f_semantic") + w.recency * F.col("f_recency") + w.confidence * F.col("f_confidence") + w.frequency * F.col("f_frequency")
    out = out.withColumn("raw_score", raw)
    final, names = boosted(F.col("raw_score"), list(config.boosts), now)
    return out.withColumn("final_score", final).withColumn("boosts", names)


def explanation() -> Column:
    """A one-line summary of the factors of a scored row."""
    part = lambda n, c: F.concat(F.lit(n + " "), F.format_string("%.2f", F.round(c, 2)))
    return F.concat_ws(", ", part("semantic", "f_semantic"), part("recency", "f_recency"), part("confidence", "f_confidence"), part("frequency", "f_frequency"))


def empty_breakdown(raw: Column) -> list[Column]:
    """The breakdown of a hit that was not scored."""
    c = lambda v, n: F.lit(v).alias(n)
    return [raw.alias("semantic"), c(1.0, "recency"), c(0.5, "confidence"), c(0.5, "frequency"), c(1.0, "w_semantic"), c(0.0, "w_recency"), c(0.0, "w_confidence"), c(0.0, "w_frequency")]


# --- staleness -----------------------------------------------------------------------------------

#: Signal weights and the action thresholds.
SIGNAL_WEIGHTS = {"time_decay": 0.5, "git_changes": 0.7, "related_updates": 0.4, "superseded": 1.0}
ACTIONS = ((0.9, "archive"), (0.6, "refresh"), (0.3, "review"))


def anchor() -> Column:
    return F.coalesce("last_refreshed_at", F.greatest("accessed_at", "created_at"))


def time_decay_signal(now: int, fresh_days: float = 7.0, full_days: float = 180.0, least: float = 0.1) -> Column:
    """min(1, age / full); null for memories younger than ``fresh_days`` and for scores under ``least``."""
    days = (F.lit(now) - anchor()) / DAY
    s = F.least(F.lit(1.0), days / full_days)
    return F.when((days >= fresh_days) & (s >= least), s)


def normal_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"^\./", ""))


def git_change_signal(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, changed, total, score) for memories with files changed after their anchor; changes: (file, last_change)."""
    files = memories.select("id", anchor().alias("anchor"), F.explode("related_files").alias("f")).withColumn("file", normal_path(F.col("f")))
    last = changes.groupBy(normal_path(F.col("file")).alias("file")).agg(F.max("last_change").alias("last_change"))
    seen = files.join(last, "file", "left").groupBy("id").agg(F.count_if(F.col("last_change") > F.col("anchor")).alias("changed"), F.count(F.lit(1)).alias("total"))
    return seen.where("changed > 0").withColumn("score", F.least(F.lit(1.0), 0.5 + 0.5 * F.col("changed") / F.col("total")))


def related_update_signal(memories: DataFrame, relations: DataFrame, least: float = 0.1) -> DataFrame:
    """(id, fresher, score): memories at one or two outgoing steps that are fresher than the anchor."""
    t = memories.select("id", anchor().alias("anchor"))
    one = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(1).alias("d"))
    two = one.alias("x").join(one.alias("y"), F.col("x.other") == F.col("y.id")).select(F.col("x.id"), F.col("y.other"), F.lit(2).alias("d"))
    near = one.union(two).where("id <> other").groupBy("id", "other").agg(F.min("d").alias("d"))
    far = t.select(F.col("id").alias("other"), F.col("anchor").alias("other_anchor"))
    gap = (F.col("other_anchor") - F.col("anchor")) / DAY
    fresher = near.join(t, "id").join(far, "other").where("other_anchor > anchor").withColumn("freshness", F.least(F.lit(1.0), 0.5 + gap / 30.0 * 0.5))
    s = F.sum(F.col("freshness") / F.col("d")) / F.sum(F.lit(1.0) / F.col("d"))
    out = fresher.groupBy("id").agg(F.count(F.lit(1)).alias("fresher"), s.alias("mean"))
    out = out.withColumn("score", F.col("mean") * F.least(F.lit(1.0), 0.4 + 0.15 * (F.col("fresher") - 1)))
    return out.where(F.col("score") >= least).select("id", "fresher", "score")


def superseded_signal(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Memories with an incoming ``supersedes`` relation."""
    by = relations.where("type = 'supersedes'").select(F.col("target_id").alias("id"))
    return memories.join(by, "id", "left_semi")


def action(composite: Column) -> Column:
    out = F.when(composite >= ACTIONS[0][0], ACTIONS[0][1])
    for bound, name in ACTIONS[1:]:
        out = out.when(composite >= bound, name)
    return out.otherwise("keep")


def staleness(memories: DataFrame, relations: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """(id, composite, signals, action) for memories with any signal; superseded memories have 1."""
    time = memories.select("id", time_decay_signal(now).alias("s_time"))
    git = git_change_signal(memories, changes).select("id", F.col("score").alias("s_git"))
    rel = related_update_signal(memories, relations).select("id", F.col("score").alias("s_related"))
    sup = superseded_signal(memories, relations).select("id", F.lit(1.0).alias("s_superseded"))
    every = time.join(git, "id", "left").join(rel, "id", "left").join(sup, "id", "left")
    w = {"s_time": SIGNAL_WEIGHTS["time_decay"], "s_git": SIGNAL_WEIGHTS["git_changes"], "s_related": SIGNAL_WEIGHTS["related_updates"]}
    zero = F.lit(0.0)
    top = sum((F.coalesce(F.col(c) * x, zero) for c, x in w.items()), zero)
    weight = sum((F.when(F.col(c).isNotNull(), x).otherwise(0.0) for c, x in w.items()), zero)
    count = sum((F.col(c).isNotNull().cast("int") for c in [*w, "s_superseded"]), F.lit(0))
    composite = F.when(F.col("s_superseded").isNotNull(), 1.0).when(weight > 0, top / weight)
    return every.where(count > 0).select("id", composite.alias("composite"), count.cast("long").alias("signals")).withColumn("action", action(F.col("composite")))
