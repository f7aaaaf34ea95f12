"""Scores of generated completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import words

# Weight of the repeated share, and the ceiling of that penalty.
REPETITION_WEIGHT = 5.0
REPETITION_CEILING = 1.0


def completion_text(messages: Column) -> Column:
    """A completion given as messages is their contents joined by a space."""
    return F.array_join(
        F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " "
    )


def completion_health(text: Column) -> Column:
    """0 for healthy text, down to -1 for repeated trigrams, one less for fewer than two words."""
    # One-element transform: the words are cut once, not again for every trigram.
    return F.transform(F.array(words(F.lower(text))), _health)[0]


def _health(spoken: Column) -> Column:
    n = F.size(spoken)
    starts = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), 1, F.greatest(n - 2, F.lit(0)))
    # Words hold no blank, so the joined string stands for the triple.
    trigrams = F.transform(starts, lambda i: F.array_join(F.slice(spoken, i, 3), " "))
    total = F.size(trigrams)
    repeated = total - F.size(F.array_distinct(trigrams))
    penalty = F.least(
        F.lit(REPETITION_CEILING), REPETITION_WEIGHT * (repeated / F.greatest(total, F.lit(1)))
    )
    short = F.when(n < 2, F.lit(1.0)).otherwise(F.lit(0.0))
    # Adding zero turns -0.0 into 0.0.
    return -(penalty + short) + F.lit(0.0)
