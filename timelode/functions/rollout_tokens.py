"""Column functions on generated token timelines (array<string>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens at which reading stops, and the days that one long-term token stands for.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[BOS]", "[EOS]"]
LONG_TERM_DAYS = 1080


def supported(task: str) -> str:
    """task, unless it is a laboratory task: generated tokens hold no laboratory values, so those can't be told zero-shot."""
    if task.startswith("lab_"):
        raise ValueError(f"{task}: laboratory values are no tokens, so there is no zero-shot evaluation")
    return task


def days_of(token: Column) -> Column:
    """Days that a token of elapsed time stands for: [DAY n], [WEEK n], [MONTH n], [LONG TERM]; 0 for all others."""
    number = lambda unit: F.regexp_extract(token, rf"\[{unit} (-?\d+)\]", 1).try_cast("int")
    return F.coalesce(number("DAY"), number("WEEK") * 7, number("MONTH") * 30, F.when(token.contains("[LONG TERM]"), LONG_TERM_DAYS), F.lit(0))


def within_horizon(tokens: Column, positive: list[str], days: int, at_most: bool = True) -> Column:
    """Whether the first positive token comes after at most (or at least) so many days, and before any special token."""
    stop = F.array(*map(F.lit, SPECIAL_TOKENS))
    good = F.array(*map(F.lit, positive))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"), F.lit(False).alias("hit"))

    def step(acc: Column, token: Column) -> Column:
        n = acc["n"] + days_of(token)
        found = F.array_contains(good, token)
        hit = (n <= days) if at_most else (n >= days)
        here = F.struct(n.alias("n"), (found | F.array_contains(stop, token)).alias("over"), (found & hit).alias("hit"))
        return F.when(acc["over"], acc).otherwise(here)

    return F.aggregate(tokens, start, step, lambda acc: acc["hit"])


def first_before(tokens: Column, positive: list[str], closing: list[str]) -> Column:
    """Whether a positive token comes before any closing or special token."""
    place = lambda names: F.array_min(F.filter(F.transform(F.array(*map(F.lit, names)), lambda x: F.array_position(tokens, x)), lambda i: i > 0))
    good, bad = place(positive), place([*closing, *SPECIAL_TOKENS])
    return F.coalesce(good < F.coalesce(bad, F.lit(2**31 - 1)), F.lit(False))
