"""Row selection: first rows, blank-row guard, default category, preview, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelens.functions import text, vocab

_BUCKETS = 1 << 20
_SPLITTERS, _FEW = 32, 100_000


def first_rows(df: DataFrame, n: int | None, key: str = "row_id") -> DataFrame:
    """``n`` rows with the smallest integer ``key``, in no order; None and 0 mean all.

    Rows without a key never count and are never picked. Of rows with the last
    key picked, those go first whose columns hash lowest; equal rows are
    alike. Only keys are counted, at once; the rows come from a filter on the
    cut-off, which the scan can push down, so no text is sorted or moved.
    """
    if not n:
        return df
    number, known = F.col(f"`{key}`"), F.col(f"`{key}`").isNotNull()
    cutoff, missing, at_cutoff = _nth(df.select(number.alias("key")).filter("key IS NOT NULL"), n)
    if cutoff is None:
        return df.filter(known)
    if missing == at_cutoff:
        return df.filter(number <= F.lit(cutoff))
    below, tied = df.filter(number < F.lit(cutoff)), df.filter(number == F.lit(cutoff))
    mark = F.xxhash64(*[df[f"`{name}`"] for name in df.columns])
    last, alike, _ = _nth(tied.select(mark.alias("key")), missing)
    picked = tied.filter(mark < F.lit(last)).unionByName(tied.filter(mark == F.lit(last)).limit(alike))
    return below.unionByName(picked)


def first_rows_by(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``n`` rows with the smallest keys of any ordered types, the first key first, in no order.

    As ``first_rows``, for texts, times and several keys: the cut-off is found
    between sampled splitters, so neither rows nor keys are sorted.
    """
    if not n:
        return df
    numbers = [df[f"`{name}`"] for name in keys]
    known = reduce(Column.__and__, [number.isNotNull() for number in numbers])
    key = F.struct(*[number.alias(f"k{at}") for at, number in enumerate(numbers)])
    cutoff, missing, at_cutoff = _nth_of_any(df.filter(known).select(key.alias("key")), n)
    if cutoff is None:
        return df.filter(known)
    last = _literal(cutoff, df.select(key.alias("key")).schema["key"].dataType)
    rows = df.filter(known & (numbers[0] <= last["k0"]))  # the scan can push this down
    if missing == at_cutoff:
        return rows.filter(key <= last)
    tied = rows.filter(key == last)
    mark = F.xxhash64(*[df[f"`{name}`"] for name in df.columns])
    end, alike, _ = _nth(tied.select(mark.alias("key")), missing)
    picked = tied.filter(mark < F.lit(end)).unionByName(tied.filter(mark == F.lit(end)).limit(alike))
    return rows.filter(key < last).unionByName(picked)


def _literal(values, kind: StructType) -> Column:
    return F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(values, kind)])


def _nth_of_any(keys: DataFrame, n: int) -> tuple[Row | None, int, int]:
    """As ``_nth``, for a ``key`` that is a struct.

    A round samples keys, sorts them on the driver into runs of runs, and counts the
    rows at each and between two. The n-th is then known, or lies between two; a
    thousandth of the rows is left for the next round. Few are sorted by Spark.
    """
    kind, total = keys.schema["key"].dataType, keys.count()
    if total <= n:
        return None, 0, 0
    inside, missing, left = keys, n, total
    while left > _FEW:
        sample = inside.orderBy(F.xxhash64("key", F.monotonically_increasing_id())).limit(_SPLITTERS * _SPLITTERS)
        found = sorted({tuple(row["key"]) for row in sample.collect()})
        runs = [found[at : at + _SPLITTERS] for at in range(0, len(found), _SPLITTERS)]
        heads = F.array(*[_literal(run[0], kind) for run in runs])
        all_runs = F.array(*[F.array(*[_literal(value, kind) for value in run]) for run in runs])
        head = F.size(F.filter(heads, lambda value: value <= F.col("key")))
        run = F.get(all_runs, head - 1)
        place = F.when(head == 0, 0).otherwise((head - 1) * _SPLITTERS + F.size(F.filter(run, lambda value: value <= F.col("key"))))
        is_at = F.coalesce(F.get(run, (place - 1) % _SPLITTERS) == F.col("key"), F.lit(False))
        counts = inside.groupBy(place.alias("place"), is_at.alias("is_at")).count().collect()  # two for each splitter
        for row in sorted(counts, key=lambda row: (row["place"], not row["is_at"])):
            if missing <= row["count"]:
                break
            missing -= row["count"]
        before = found[row["place"] - 1] if row["place"] else None
        if row["is_at"]:
            return before, missing, row["count"]
        if before is not None:
            inside = inside.filter(F.col("key") > _literal(before, kind))
        if row["place"] < len(found):
            inside = inside.filter(F.col("key") < _literal(found[row["place"]], kind))
        left = row["count"]
    cutoff = inside.orderBy("key").limit(missing).agg(F.max("key")).first()[0]
    below, at = inside.agg(F.count_if(F.col("key") < _literal(cutoff, kind)), F.count_if(F.col("key") == _literal(cutoff, kind))).first()
    return tuple(cutoff), missing - below, at


def last_rows(df: DataFrame, n: int, key: str = "seq") -> DataFrame:
    """The ``n`` rows with the greatest key, for a small ``n``, found the same way."""
    ranked = df.select(F.col(key).alias("key")).orderBy(F.desc("key")).limit(n)
    cutoff = ranked.agg(F.min("key")).first()[0]
    return df.filter(F.col(key) >= F.lit(cutoff)).orderBy(F.desc(key)).limit(n)


def _nth(keys: DataFrame, n: int) -> tuple[int | None, int, int]:
    """The n-th smallest ``key``, which of the rows with that key it is, and their number.

    None if there are at most n. A pass counts rows in about a million equal key
    ranges and descends into the one that holds the n-th, so two passes do for
    keys within a million millions of each other, and four for any. One row
    of each pass reaches the driver.
    """
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if total <= n:
        return None, 0, 0
    missing = n
    while True:
        width = (high - low) // _BUCKETS + 1
        # Decimals, because the distance between two 64-bit keys needs 65 bits.
        bucket = f"(cast(key AS decimal(20, 0)) - cast('{low}' AS decimal(20, 0))) div cast('{width}' AS decimal(20, 0))"
        counts = keys.filter(F.col("key").between(low, high)).groupBy(F.expr(bucket).alias("bucket")).agg(F.count("*").alias("n"))
        sums = counts.withColumn("upto", F.expr("sum(n) OVER (ORDER BY bucket)"))  # at most a million rows
        holds = sums.filter(F.col("upto") >= missing).agg(F.min(F.struct("bucket", "n", "upto")).alias("first")).first()["first"]
        missing -= holds["upto"] - holds["n"]
        low = low + int(holds["bucket"]) * width
        if width == 1:
            return low, missing, holds["n"]
        high = min(low + width - 1, high)


def split_blank(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose named columns all have text, and the refused rows with a reason."""
    reason = F.coalesce(*[
        F.when(text.is_blank(F.col(name)), F.lit(f"blank {name}")) for name in names
    ])
    kept = df
    for name in names:
        kept = kept.filter(~text.is_blank(F.col(name)))
    return kept, df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def category_or_default(category: Column) -> Column:
    return F.when(text.is_blank(category), F.lit(vocab.DEFAULT_CATEGORY)).otherwise(category)


def preview(df: DataFrame, key: str = "row_id", width: int = 100) -> DataFrame:
    """The first row as one (field, preview) row per column other than the key."""
    first = first_rows(df, 1, key)
    cells = [
        F.struct(
            F.lit(name).alias("field"),
            F.substring(F.coalesce(F.col(name).cast("string"), F.lit("None")), 1, width).alias("preview"),
        )
        for name in df.columns
        if name != key
    ]
    return first.select(F.inline(F.array(*cells)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))
