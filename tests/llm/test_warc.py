from __future__ import annotations

import base64
import hashlib
import os

from codelens.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a/3", "<p>one</p>"), (4, None, "<p>one</p>"),
    (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://a/7", "<p>two</p>"), (8, "http://a/8 x\r\nEvil: 1", "é\r\n\r\nü" * 3),
    (9, "http://a/9", "big " * 50_000), (10, "http://a/10", "lone"), (11, "u", "same"), (11, "u", "same"), (None, None, None),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def brute(rows, least=0):
    out, groups = [], {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for at, own in enumerate(ids):
            again = len(payload) >= least and at < len(ids) - 1
            out.append((own, len(payload), digest, "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip(spark):
    for least in (0, 5):
        assert rows_of(warc.round_trip(frame(spark), least)) == brute(PAGES, least)


def test_texts_come_back(spark):
    got = {r.page_id: r.html for r in warc.round_trip(frame(spark)).filter("record_type = 'response'").collect()}
    assert got[8] == "é\r\n\r\nü" * 3 and got[9] == "big " * 50_000


def content(folder):
    names = sorted(name for name in os.listdir(folder) if name.endswith(".gz"))
    return {name: open(f"{folder}/{name}", "rb").read() for name in names}


def test_same_files_however_rows_are_split(spark, tmp_path):
    rows = [(n, f"http://a/{n}", f"<p>{hashlib.sha256(str(n).encode()).hexdigest() * (n % 40)}</p>") for n in range(400)]
    for name, parts in (("one", 2), ("two", 7)):
        made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        manifest = warc.write_warc(made, f"{tmp_path}/{name}", shard_bytes=100_000, file_bytes=4_000)
        assert rows_of(warc.read_warc(manifest, f"{tmp_path}/{name}")) == brute(rows)
    one, two = content(f"{tmp_path}/one"), content(f"{tmp_path}/two")
    assert one == two and len(one) > 10
    assert len({name[:8] for name in one}) > 3 and all(len(file) <= 4_000 for file in one.values())


def test_commit_leaves_no_temporary_names_and_can_rerun(spark, tmp_path):
    manifest = warc.write_warc(frame(spark), f"{tmp_path}/x")
    assert {r.file for r in manifest.collect()} == set(content(f"{tmp_path}/x"))
    assert os.listdir(f"{tmp_path}/x/_temporary") == []


def test_empty_table_and_other_columns(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "u", "x", 5, "y")], "page_id long, url string, html string, rid int, shard string")
    assert rows_of(warc.round_trip(odd)) == brute([(1, "u", "x")])


def test_files_are_what_the_standard_says(spark, tmp_path):
    """Read as any reader would: file records first, revisits that name a response which is there."""
    warc.write_warc(frame(spark), f"{tmp_path}/w", file_bytes=3_000, shard_bytes=60_000).collect()
    files = {name: list(warc.records(data)) for name, data in content(f"{tmp_path}/w").items()}
    assert len(files) > 1
    for name, found in files.items():
        fields, block = found[0]
        assert (fields["WARC-Type"], fields["WARC-Filename"], fields["Content-Type"]) == ("warcinfo", name, "application/warc-fields")
        assert b"format: WARC File Format 1.1\r\n" in block
        assert all(fields["WARC-Type"] in ("response", "revisit") for fields, _ in found[1:])
    pages = [fields for found in files.values() for fields, _ in found[1:]]
    assert len(pages) == len(PAGES) and len({fields["WARC-Record-ID"] for fields in pages if fields["WARC-Type"] == "response"}) == 7
    responses = {fields["WARC-Record-ID"]: fields for fields in pages if fields["WARC-Type"] == "response"}
    for fields in pages:
        if fields["WARC-Type"] == "revisit":
            meant = responses[fields["WARC-Refers-To"]]
            assert meant["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] and meant["WARC-Date"] == fields["WARC-Refers-To-Date"]
            assert meant.get("WARC-Target-URI") == fields.get("WARC-Refers-To-Target-URI")
            assert meant.get("WARC-Page-ID") == fields.get("WARC-Refers-To-Page-ID")
            assert fields["WARC-Profile"].endswith("/revisit/identical-payload-digest")


def test_a_page_that_is_most_rows_lies_in_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 50)
    rows = [(7, None, "copied")] * 1_000 + [(n, "u", f"own {n}") for n in range(20)] + [(3, "v", "copied")] * 200
    for name, parts in (("one", 1), ("two", 5)):
        made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        manifest = warc.write_warc(made, f"{tmp_path}/{name}", least_bytes=5, shard_bytes=60_000)
        assert rows_of(warc.read_warc(manifest, f"{tmp_path}/{name}")) == brute(rows, 5)
        counts = [r.n_records for r in manifest.collect()]
        assert sum(counts) == len(rows) and len(counts) > 8 and max(counts) <= 200
        planned, _ = warc.planned(made, 5, 60_000)
        assert planned.filter("payload IS NOT NULL").count() <= 21 * parts
    assert content(f"{tmp_path}/one") == content(f"{tmp_path}/two")
    manifest = warc.write_warc(made, f"{tmp_path}/small", least_bytes=100, shard_bytes=60_000)
    assert rows_of(warc.read_warc(manifest, f"{tmp_path}/small")) == brute(rows, 100)
