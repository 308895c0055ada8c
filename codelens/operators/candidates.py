"""Several generated candidates per prompt, held as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import vocab


def fan_out(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """One row per candidate, numbered from 1 in list order."""
    others = [name for name in df.columns if name != candidates]
    return df.select(*others, F.posexplode(candidates).alias("_at", "candidate")).select(
        *others, (F.col("_at") + 1).alias("candidate_no"), "candidate"
    )


def merge(candidates: Column) -> Column:
    """One text of all candidates; a single candidate stays as it is.

    The rule line comes once, in front of the first block and without a line
    break after it.
    """
    blocks = F.transform(
        candidates,
        lambda body, at: F.concat(F.lit("Output "), (at + 1).cast("string"), F.lit(":\n"), body),
    )
    merged = F.concat(F.lit(vocab.CANDIDATE_RULE), F.array_join(blocks, vocab.SECTION_GAP))
    return F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0))).otherwise(merged)
