from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codelens.plans.layout import shared_folder
from codelens.sources import files, runlog
from codelens.sources.runlog import RunLog

SCHEMA = StructType([StructField("seq", LongType()), StructField("said", StringType())])


def rows(spark, first, end, said="a"):
    return spark.createDataFrame([(n, said) for n in range(first, end)], SCHEMA).coalesce(1)


def seen(log, upto=None):
    return sorted(tuple(row) for row in log.rows(upto).collect())


def new_log(spark):
    return RunLog(spark, shared_folder(spark, "log"), SCHEMA)


class Lost(Exception):
    pass


def cut_off(monkeypatch, step):
    """Lets the writer die before its ``step``-th change of the store."""
    left = [step]
    for name in ("_write", "delete"):
        whole = getattr(files, name)

        def change(*args, whole=whole):
            left[0] -= 1
            if left[0] < 0:
                raise Lost
            return whole(*args)

        monkeypatch.setattr(files, name, change)


@pytest.mark.parametrize("step", range(5))
def test_a_save_that_ends_at_any_point_is_finished_by_a_retry(spark, monkeypatch, step):
    log = new_log(spark)
    log.add(rows(spark, 0, 3), "first")
    with monkeypatch.context() as patch:
        cut_off(patch, step)
        try:
            log.add(rows(spark, 3, 6), "second")
        except Lost:
            pass
    assert seen(log) in ([(n, "a") for n in range(3)], [(n, "a") for n in range(6)])  # nothing or all of it
    for _ in range(2):
        log.add(rows(spark, 3, 6), "second")
        assert seen(log) == [(n, "a") for n in range(6)]
    assert not log.add(rows(spark, 0, 3), "first") and log.latest() == 2
    assert log.add(rows(spark, 6, 7), "third") and len(seen(log)) == 7


def test_files_without_an_entry_do_not_count_and_are_cleaned(spark):
    log = new_log(spark)
    rows(spark, 0, 9).write.parquet(f"{log.folder}/data/lost-attempt")
    Path(f"{log.folder}/data/run=x").mkdir()
    assert seen(log) == []
    assert log.add(rows(spark, 0, 2), "run") and not log.add(rows(spark, 0, 2), "run")
    assert log.clean() == 0 and log.clean(hours=0) == 2
    assert seen(log) == [(0, "a"), (1, "a")]
    with pytest.raises(ValueError):
        log.add(rows(spark, 0, 1), "../b")


def test_two_writers_of_one_run_or_of_two(spark, monkeypatch):
    """Another writer takes the next version while this one has written its files."""
    for other in ("same", "different"):
        log, rival = new_log(spark), None
        rival = RunLog(spark, log.folder, SCHEMA)
        commit = log._commit

        def late(entry, rival=rival, other=other, commit=commit):
            rival.add(rows(spark, 10, 12, "rival"), "same" if other == "same" else "theirs")
            return commit(entry)

        monkeypatch.setattr(log, "_commit", late)
        assert log.add(rows(spark, 0, 2), "same") == (other == "different")
        assert len(seen(log)) == (2 if other == "same" else 4)


def test_fifty_runs_compacted_while_a_reader_follows(spark):
    log = new_log(spark)
    position, got = 0, []
    for n in range(50):
        log.add(rows(spark, 2 * n, 2 * n + 2), f"run-{n}")
        if n % 20 == 11:
            assert log.compact()
            assert log.clean(hours=0) >= 12
        if n % 7 == 3:
            added, replaced = log.changes(position, log.latest())
            position, got = log.latest(), got + [row["seq"] for row in added.collect()]
            assert replaced is None
    added, _ = log.changes(position, log.latest())
    assert sorted(got + [row["seq"] for row in added.collect()]) == list(range(100))
    assert seen(log) == [(n, "a") for n in range(100)] and log.latest() == 52
    generation, entries = log.state()
    assert len(generation["files"]) == 1 and len(entries) == 18  # runs 32 to 49
    assert log.compact() and not log.compact()
    assert not log.add(rows(spark, 0, 1), "run-3")  # known, though its entry was merged
    assert seen(log) == [(n, "a") for n in range(100)]


def test_a_run_added_during_a_compaction_is_kept(spark, monkeypatch):
    log = new_log(spark)
    log.add(rows(spark, 0, 5), "one")
    write = log._write

    def slow(frame, attempt):
        monkeypatch.undo()
        log.add(rows(spark, 5, 7), "meanwhile")
        log.add(rows(spark, 0, 1, "right"), "fixed", corrects=True)
        return write(frame, attempt)

    monkeypatch.setattr(log, "_write", slow)
    log.compact()
    assert seen(log) == [(0, "right"), *((n, "a") for n in range(1, 7))]


def test_a_lost_hint_is_made_good(spark):
    log = new_log(spark)
    for n in range(3):
        log.add(rows(spark, n, n + 1), f"run-{n}")
    log.compact()
    for hint in ("_latest", "_generation"):
        files.delete(spark, f"{log.folder}/log/{hint}")
    assert log.latest() == 4 and log.state()[0]["as_of"] == 3 and len(seen(log)) == 3
    assert log.add(rows(spark, 3, 4), "run-3") and len(seen(log)) == 4


def test_corrections_of_corrections(spark):
    log = new_log(spark)
    log.add(rows(spark, 0, 4, "v1"), "one")
    log.add(rows(spark, 1, 3, "v2"), "two", corrects=True)
    log.add(rows(spark, 2, 6, "v3"), "three", corrects=True)
    views = {
        1: [(n, "v1") for n in range(4)],
        2: [(0, "v1"), (1, "v2"), (2, "v2"), (3, "v1")],
        3: [(0, "v1"), (1, "v2"), (2, "v3"), (3, "v3"), (4, "v3"), (5, "v3")],
    }
    for _ in range(2):  # before and after compaction
        assert {version: seen(log, version) for version in views} == views and seen(log) == views[3]
        for after, upto in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)):
            added, replaced = log.changes(after, upto)
            gone = [] if replaced is None else [tuple(row) for row in replaced.select("seq", "said").collect()]
            before = views.get(after, [])
            assert sorted(set(before) - set(gone) | {tuple(row) for row in added.collect()}) == views[upto]
        log.compact()
        log.clean(hours=0)
    log.add(rows(spark, 0, 1, "v5"), "four", corrects=True)
    log.compact()
    assert seen(log) == [(0, "v5"), *views[3][1:]] and seen(log, 2) == views[2]


def test_a_compaction_sorts_a_bounded_part_in_a_task(spark, monkeypatch):
    """Rows that take few bytes in a file and many in memory."""
    monkeypatch.setattr(runlog, "SORT_BYTES", 100_000)
    log = runlog.RunLog(spark, shared_folder(spark, "packed"), StructType.fromDDL("seq long, word string"))
    rows = spark.range(1000).selectExpr("id as seq", "repeat('x', 1000) as word")
    assert log.add(rows, "one") and log.compact()
    assert 8 <= len(log.state()[0]["files"]) <= 12
    assert sorted(log.rows().collect()) == sorted(rows.collect())
