"""A table of runs, and the log that says which files belong to it.

``data/<attempt>`` holds the files of one attempt to save a run. ``log/<version>.json``
is written last and names them; versions count from 1 without gaps, each is written
whole by a rename that refuses to replace another. Readers take the files that the
log names and nothing else, so a save that ends at any point is either not seen or
complete, and saving the run again finishes it:

- before the log entry, whatever was written is not part of the table;
- after it, the run is found stored. ``log/runs/<run>`` marks it; a writer first
  marks the run of the last entry, so one look at the mark and one at the last entry
  tell if a run is there, however long the log.

``compact`` writes the runs up to a version into a few files sorted by key, each row
with the version it came with, and logs them as a generation. Readers take the last
generation and the runs after it. A reader that has seen everything up to a version
takes the rows after it from either, so a stream goes on across compactions, and the
files of merged runs can go (``clean``).

A run saved with ``corrects`` replaces rows of earlier versions with the same key:
readers leave those out, by a join with the corrected keys only. A generation keeps
replaced rows in files of their own, for readers of earlier versions.

Finding the last version costs a few look-ups from a hint, not a listing. Where the
store's rename replaces files (some object stores), let one job write at a time.
"""

from __future__ import annotations

import json
import re
import sys
import time
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from codelens.plans.layout import broadcast_if_small
from codelens.sources import files

_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
FILE_BYTES = 128 * 1024 * 1024
SORT_BYTES = 512 * 1024 * 1024  # of rows that one task of a compaction sorts
VERSION, REPLACED = "_version", "_replaced"

# Workers get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _entry_name(folder: str, version: int) -> str:
    return f"{folder}/log/{version:020d}.json"


class RunLog:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "seq"):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key

    # The log

    def latest(self) -> int:
        """The last version; 0 if there is none."""
        version = int(files.read_text(self.spark, f"{self.folder}/log/_latest") or 0)
        while files.exists(self.spark, _entry_name(self.folder, version + 1)):
            version += 1
        return version

    def entry(self, version: int) -> dict:
        return json.loads(files.read_text(self.spark, _entry_name(self.folder, version)))

    def _mark(self, version: int) -> None:
        """Makes the run of that version known by its name."""
        run = self.entry(version)["run"] if version else None
        if run and not files.exists(self.spark, f"{self.folder}/log/runs/{run}"):
            files.put(self.spark, f"{self.folder}/log/runs/{run}", str(version))

    def has(self, run: str) -> bool:
        self._mark(self.latest())
        return files.exists(self.spark, f"{self.folder}/log/runs/{run}")

    def _commit(self, entry: dict) -> bool:
        """Logs the entry as the next version, unless its run was logged meanwhile."""
        while not (entry["run"] and self.has(entry["run"])):
            version = self.latest() + 1
            if files.create(self.spark, _entry_name(self.folder, version), json.dumps(entry)):
                self._mark(version)
                files.put(self.spark, f"{self.folder}/log/_latest", str(version))
                return True
        return False

    def _write(self, rows: DataFrame, attempt: str) -> tuple[list[str], int]:
        place = f"{self.folder}/data/{attempt}"
        rows.write.parquet(place)
        found = [(name, size) for name, size, _ in files.details(self.spark, place) if name.endswith(".parquet")]
        return [f"{attempt}/{name}" for name, _ in found], sum(size for _, size in found)

    def add(self, rows: DataFrame, run: str, corrects: bool = False) -> bool:
        """Saves a run, unless it is stored; with ``corrects`` it replaces rows with the same keys."""
        if not _RUN_ID.fullmatch(run):
            raise ValueError(f"not a run id: {run!r}")
        if self.has(run):
            return False
        attempt = f"{run}-{uuid.uuid4().hex}"
        names, size = self._write(rows.select(*self.schema.names), attempt)
        stored = self._commit({"kind": "run", "run": run, "attempt": attempt, "files": names, "bytes": size, "corrects": corrects})
        if not stored:
            files.delete(self.spark, f"{self.folder}/data/{attempt}")
        return stored

    # Reading

    def _entries(self, after: int, upto: int) -> list[dict]:
        return [{**self.entry(version), "version": version} for version in range(after + 1, upto + 1)]

    def state(self, upto: int | None = None, after: int = 0) -> tuple[dict | None, list[dict]]:
        """The last generation, and the runs it lacks after ``after`` and up to ``upto``."""
        latest = self.latest()
        hint = int(files.read_text(self.spark, f"{self.folder}/log/_generation") or 0)
        generation = {**self.entry(hint), "version": hint} if hint else None
        entries = self._entries(max(after, generation["as_of"] if generation else 0), latest)
        for entry in entries:  # one that was logged after the hint
            if entry["kind"] == "generation" and (generation is None or entry["as_of"] > generation["as_of"]):
                generation = entry
        low, high = generation["as_of"] if generation else 0, latest if upto is None else upto
        return generation, [entry for entry in entries if entry["kind"] == "run" and low < entry["version"] <= high]

    def _paths(self, names: list[str]) -> list[str]:
        return [f"{self.folder}/data/{name}" for name in names]

    def _runs(self, entries: list[dict], versions: bool) -> DataFrame:
        """Rows of those runs, with their versions if asked for."""
        spark, names = self.spark, [name for entry in entries for name in entry["files"]]
        if not names:
            rows = spark.createDataFrame([], self.schema)
            return rows.withColumn(VERSION, F.lit(0).cast("long")) if versions else rows
        rows = spark.read.schema(self.schema).parquet(*self._paths(names))
        if not versions:
            return rows
        known = spark.createDataFrame([(entry["attempt"], entry["version"]) for entry in entries], f"_attempt string, {VERSION} long")
        attempt = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/[^/]+$", 1)
        return rows.withColumn("_attempt", attempt).join(F.broadcast(known), "_attempt").drop("_attempt")

    def _merged(self, generation: dict | None, upto: int) -> DataFrame:
        """Rows of the generation that counted at ``upto``, with their versions."""
        schema = StructType([*self.schema.fields, StructField(VERSION, LongType()), StructField(REPLACED, LongType())])
        if generation is None:
            return self.spark.createDataFrame([], schema).drop(REPLACED)
        names = generation["files"] + (generation["replaced"] if upto < generation["as_of"] else [])
        if not names:
            return self.spark.createDataFrame([], schema).drop(REPLACED)
        rows = self.spark.read.schema(schema).parquet(*self._paths(names))
        if upto < generation["as_of"]:
            rows = rows.filter((F.col(VERSION) <= upto) & (F.col(REPLACED).isNull() | (F.col(REPLACED) > upto)))
        return rows.drop(REPLACED)

    def _corrections(self, entries: list[dict]) -> DataFrame | None:
        """The versions each key was corrected in, in order, or None if no run corrects."""
        correcting = [entry for entry in entries if entry["corrects"]]
        if not correcting:
            return None
        return self._runs(correcting, True).groupBy(F.col(self.key).alias("_key")).agg(F.array_sort(F.collect_set(VERSION)).alias("_versions"))

    def _all(self, upto: int | None = None) -> DataFrame:
        """Every row that counts at ``upto``, with its version."""
        upto = self.latest() if upto is None else upto
        generation, entries = self.state(upto)
        rows = self._merged(generation, upto).unionByName(self._runs(entries, True))
        corrections = self._corrections(entries)
        if corrections is None:
            return rows
        corrections = broadcast_if_small(corrections)
        return rows.join(corrections, (F.col(self.key) == F.col("_key")) & (F.col(VERSION) < F.element_at("_versions", -1)), "left_anti")

    def rows(self, upto: int | None = None) -> DataFrame:
        """Every row that counts, now or at the version ``upto``."""
        generation, entries = self.state(upto)
        if any(entry["corrects"] for entry in entries) or generation and upto is not None and upto < generation["as_of"]:
            return self._all(upto).drop(VERSION)
        parts = [self._merged(generation, generation["as_of"]).drop(VERSION)] if generation else []
        if entries or not parts:
            parts.append(self._runs(entries, False))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def changes(self, after: int, upto: int) -> tuple[DataFrame, DataFrame | None]:
        """Rows new at ``upto`` since ``after``, and the rows they replaced (None if nothing was corrected)."""
        generation, late = self.state(upto, after)
        merged = generation is not None and after < generation["as_of"]
        corrects = any(entry["corrects"] for entry in late) or merged and bool(generation["replaced"])
        if not corrects:
            rows = self._runs(late, False)
            return (self._merged(generation, upto).filter(F.col(VERSION) > after).drop(VERSION).unionByName(rows) if merged else rows), None
        added = self._all(upto).filter(F.col(VERSION) > after).drop(VERSION)
        keys = [self._runs([entry], False).select(self.key) for entry in late if entry["corrects"]]
        if merged and generation["replaced"]:
            replaced = self.spark.read.parquet(*self._paths(generation["replaced"]))
            keys.append(replaced.filter((F.col(REPLACED) > after) & (F.col(REPLACED) <= upto)).select(self.key))
        corrected = keys[0]
        for more in keys[1:]:
            corrected = corrected.union(more)
        before = self._all(after).drop(VERSION)
        return added, before.join(broadcast_if_small(corrected.distinct()), self.key, "left_semi")

    # Housekeeping

    def compact(self, file_bytes: int = FILE_BYTES) -> bool:
        """Merges the last generation and the runs after it into few files, sorted by key."""
        as_of = self.latest()
        generation, entries = self.state(as_of)
        if not entries:
            return False
        rows = self._merged(generation, as_of).unionByName(self._runs(entries, True))
        corrections = self._corrections(entries)
        if corrections is None:
            current, replaced = rows.withColumn(REPLACED, F.lit(None).cast("long")), None
        else:
            # A row counts until the first correction after it.
            first = F.get(F.filter("_versions", lambda version: version > F.col(VERSION)), 0)
            judged = rows.join(broadcast_if_small(corrections), F.col(self.key) == F.col("_key"), "left")
            judged = judged.withColumn(REPLACED, first).drop("_key", "_versions")
            current, replaced = judged.filter(F.col(REPLACED).isNull()), judged.filter(F.col(REPLACED).isNotNull())
        attempt = f"generation-{uuid.uuid4().hex}"
        # Tasks sort rows as they are in memory, which take many times the bytes of their files.
        size = current.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
        stored = sum(entry["bytes"] for entry in entries) + (generation["bytes"] if generation else 0)
        parts = max(1, round(stored / file_bytes), -(-size // SORT_BYTES))
        names, written = self._write(current.repartitionByRange(parts, self.key).sortWithinPartitions(self.key), attempt)
        old = list(generation["replaced"]) if generation else []
        if replaced is not None:
            more, _ = self._write(replaced.repartitionByRange(self.key), f"{attempt}-replaced")
            old += more
        self._commit({"kind": "generation", "run": None, "attempt": attempt, "files": names, "replaced": old, "bytes": written, "as_of": as_of, "corrects": False})
        version = self.latest()
        while self.entry(version)["kind"] != "generation":
            version -= 1
        files.put(self.spark, f"{self.folder}/log/_generation", str(version))
        return True

    def clean(self, hours: float = 168) -> int:
        """Deletes folders of unfinished saves and merged runs that have not changed for so long; how many.

        Give it more time than the longest save and the longest read take.
        """
        generation, entries = self.state()
        names = [name for entry in entries for name in entry["files"]]
        names += generation["files"] + generation["replaced"] if generation else []
        live, gone = {name.split("/")[0] for name in names}, 0
        for name, _, changed in files.details(self.spark, f"{self.folder}/data"):
            if name not in live and changed < (time.time() - hours * 3600) * 1000:
                files.delete(self.spark, f"{self.folder}/data/{name}")
                gone += 1
        return gone


# Streams of positions in the log


class _Positions(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class _LogReader(DataSourceStreamReader):
    """Offsets are versions. The last is looked for from the one before, so a trigger costs as
    many look-ups as there are new entries, and no file is too old."""

    def __init__(self, folder: str):
        self.folder, self.version = folder, None

    def _store(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        if "://" not in self.folder and not self.folder.startswith("file:"):
            return LocalFileSystem(), self.folder
        if self.folder.startswith("file:"):
            return LocalFileSystem(), "/" + self.folder.removeprefix("file:").lstrip("/")
        return FileSystem.from_uri(self.folder.replace("s3a://", "s3://", 1))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileType

        store, inner = self._store()
        if self.version is None:
            hint = f"{inner}/log/_latest"
            self.version = int(store.open_input_file(hint).read()) if store.get_file_info(hint).type == FileType.File else 0
        while store.get_file_info(_entry_name(inner, self.version + 1)).type == FileType.File:
            self.version += 1
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Positions(start["version"], end["version"])] if start["version"] < end["version"] else []

    def read(self, partition: InputPartition):
        yield partition.after, partition.upto


class RunLogSource(DataSource):
    """One row for each micro-batch: the versions after which and up to which there are new entries."""

    @classmethod
    def name(cls) -> str:
        return "codelens_run_log"

    def schema(self) -> str:
        return "after long, upto long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LogReader(self.options["path"])
