"""Speech transcripts: joining fragments and character error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.text import trimmed


def accumulate(fragments: Column) -> Column:
    """Join streamed fragments in order: one that extends the text so far replaces it, one that
    the text already ends with is skipped, any other is appended."""

    def step(text: Column, fragment: Column) -> Column:
        return (
            F.when(fragment == "", text)
            .when(F.startswith(fragment, text), fragment)
            .when(F.endswith(text, fragment), text)
            .otherwise(F.concat(text, fragment))
        )

    return F.aggregate(fragments, F.lit(""), step)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the length of the trimmed reference, in code points; null if empty."""
    expected, heard = trimmed(reference), trimmed(hypothesis)
    return F.levenshtein(heard, expected) / F.nullif(F.char_length(expected), F.lit(0))
