"""Token budgets: shares, minimums, maximums, surplus and deficit, as expressions over a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("system", "context", "user", "response")
# Presets of shares, the order surplus is given and deficit is taken, and context windows.
RATIOS = {"balanced": (0.1, 0.6, 0.2, 0.1), "conservative": (0.1, 0.5, 0.15, 0.25), "context_heavy": (0.05, 0.75, 0.1, 0.1), "chat": (0.1, 0.4, 0.3, 0.2)}
SURPLUS = ("context", "user", "response", "system")
DEFICIT = ("system", "response", "user", "context")
WINDOWS = {
    "gpt-4-turbo": 128000, "gpt-4": 8192, "gpt-3.5-turbo": 16385, "claude-opus": 200000, "claude-sonnet": 200000, "claude-haiku": 200000,
    "llama-3-70b": 8192, "llama-3-8b": 8192, "mistral-medium": 32000, "mixtral-8x7b": 32000,
}


def allocate(total: Column, ratios: tuple[float, ...], minimums: dict[str, int] | None = None, maximums: dict[str, int] | None = None) -> dict[str, Column]:
    """The four shares of ``total`` (long)."""
    low, high = minimums or {}, maximums or {}
    got = {c: F.floor(total * F.lit(r)) for c, r in zip(CATEGORIES, ratios, strict=True)}
    got = {c: F.greatest(x, F.lit(low[c])) if c in low else x for c, x in got.items()}
    got = {c: F.least(x, F.lit(high[c])) if c in high else x for c, x in got.items()}
    left = total - sum(got.values(), F.lit(0))
    surplus, given = F.greatest(left, F.lit(0)), F.lit(False)
    for c in SURPLUS:
        may = ~given & ((got[c] < high[c]) if c in high else F.lit(True))
        got[c], given = F.when(may, got[c] + surplus).otherwise(got[c]), given | may
    short = F.greatest(-left, F.lit(0))
    for c in DEFICIT:
        take = F.least(F.greatest(got[c] - low.get(c, 0), F.lit(0)), short)
        got[c], short = got[c] - take, short - take
    return {c: x.cast("long") for c, x in got.items()}
