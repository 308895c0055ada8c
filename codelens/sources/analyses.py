"""Analyses kept across jobs: each distinct text is parsed once, ever.

The store is a table of runs (``runlog``) with one row for each text: its hash, the
text and the analysis. Texts meet by hash and SHA-256 digest, so equal hashes of
different texts cost nothing but a comparison, and only texts to parse are moved. A job
first parses the texts the store lacks, then attaches analyses by a join, whose plan has
no Python. Where the store is much larger than the job, a Bloom filter of the job's
texts, if it is small enough to broadcast, keeps the rest of the store from being
shuffled; the results are the same without it.

No text is stored twice: a run is named after the run before it, so of two jobs that
saw the same store one is refused, and looks again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelens.functions import bloom, python_ast, text
from codelens.operators.analysis import ANALYSIS, analyse
from codelens.plans.layout import broadcast_if_small, settle, tasks_for
from codelens.sources.runlog import RunLog

HASH, TEXT, DIGEST = "_code_hash", "_code_text", "_code_digest"
FILTER_FROM = 4  # store rows for each row of the job; asking the filter costs as much as moving a row
_COLUMNS = f"{HASH} long, {TEXT} string, {ANALYSIS} {python_ast.ANALYSIS_TYPE}"


def store(spark: SparkSession, path: str) -> RunLog:
    """The table of analyses, to compact or clean."""
    return RunLog(spark, path, StructType.fromDDL(_COLUMNS), HASH)


def _keyed(df: DataFrame, code: str) -> DataFrame:
    known = text.or_empty(F.col(code))
    return df.withColumns({TEXT: known, HASH: F.xxhash64(known)})


def _with_digest(df: DataFrame) -> DataFrame:
    """Keyed or stored rows; the digest is made from the text, so a store needs no column for it."""
    return df.withColumn(DIGEST, F.unhex(F.sha2(TEXT, 256)))


def _stored_for(keyed: DataFrame, n_rows: int, path: str) -> DataFrame:
    """The stored rows that so many keyed rows may ask for, with digests."""
    stored = store(keyed.sparkSession, path).rows()
    blocks = bloom.blocks_for(n_rows)
    if blocks is not None and stored.count() > FILTER_FROM * n_rows:
        stored = bloom.may_hold(stored, F.col(HASH), bloom.build(keyed, F.col(HASH), blocks), blocks)
    return _with_digest(stored)


def _last_run(log: RunLog) -> int:
    version = log.latest()
    while version and log.entry(version)["kind"] != "run":
        version -= 1
    return version


def add(df: DataFrame, path: str, code: str = "generated_code") -> int:
    """Parses and stores the texts that the store lacks; how many."""
    keyed = _keyed(df, code).select(HASH, TEXT)
    # Distinct before it moves: a text that many rows share moves once from each task.
    wanted = keyed.dropDuplicates([HASH, TEXT])
    n_rows, cores = keyed.count(), df.sparkSession.sparkContext.defaultParallelism
    log = store(df.sparkSession, path)
    while n_rows:
        seen = _last_run(log)
        fresh, most = wanted, n_rows
        if seen:
            keys = _with_digest(keyed).select(HASH, DIGEST).distinct()
            lacking = settle(keys.join(_stored_for(keyed, n_rows, path), [HASH, DIGEST], "left_anti"))
            most = lacking.count()
            if not most:
                return 0
            fresh = _with_digest(wanted).join(broadcast_if_small(lacking), [HASH, DIGEST], "left_semi").select(HASH, TEXT)
        # Dealt out by rows: Spark sizes tasks by bytes, of which small ones can be long to parse.
        fresh = settle(fresh.repartition(tasks_for(most, cores), HASH))
        if log.add(analyse(fresh, TEXT), f"after-{seen}"):
            return fresh.count()
    return 0


def attach(df: DataFrame, path: str, code: str = "generated_code") -> DataFrame:
    """Adds the stored ``analysis``, null where the text was never added; nothing is parsed.

    A text that many rows share makes one side of the join skewed, which Spark splits.
    """
    keyed = _keyed(df, code)
    stored = _stored_for(keyed, keyed.count(), path).select(HASH, DIGEST, ANALYSIS)
    return _with_digest(keyed).join(stored, [HASH, DIGEST], "left").select(*df.columns, ANALYSIS)


def analyse_stored(df: DataFrame, path: str, code: str = "generated_code") -> DataFrame:
    """As ``analysis.analyse``, but texts that any job has stored are not parsed again."""
    add(df, path, code)
    return attach(df, path, code)
