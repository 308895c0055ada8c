"""Deterministic sharded WARC writer, and a reader for what it writes.

Records are ordered by page, address and content. Running totals of their sizes
cut that order into shards, so shards depend on the rows alone and not on how
Spark happened to split them. A task writes a shard's records in order, each as
a gzip member of its own, and starts a new file before one would exceed
``file_bytes`` compressed. Headers, lengths and digests are made anew from the
payload. Files get temporary names that hold the attempt; the stored manifest
names one attempt for each shard, and only those files are renamed. A commit
that is interrupted can be run again. Files of lost attempts are never read.

Every file begins with a record that describes it; ``n_records`` counts the others.
Of records with equal payloads, of at least ``least_bytes``, the one with the
largest page id is a response; the others are revisits, which have the HTTP
header with the payload's length but not the payload, and name the response by its
record id, address, date and page. Smaller ones are all
responses. Null html counts as empty. A null page id ranks below all others, and
among rows with the largest id the one with the last address is the response,
and among repeated rows the first written. A null address
leaves its header out; control characters and spaces in one are percent-encoded.
Other columns are not written. A single record may exceed ``file_bytes``. Repeated
rows (equal page, address and content) are counted, not moved: each ``COPIES`` of them
have a place of their own, so a page that holds a third of all rows lies in many
shards, and a revisit is written from its digests without its payload. An
empty table gives an empty manifest and no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import running_totals, spread_out, store
from codelens.plans.layout import shared_folder

SHARD_BYTES, FILE_BYTES = 16 << 20, 8 << 20
HEADER_BYTES = 512  # a record's weight besides its payload
COPIES = 4096  # repeated rows with one place
SEEN = 1 << 16  # rows a task remembers so as not to hand on a payload again
DATE = "1970-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of addresses
MANIFEST = "shard long, seq long, temporary string, file string, n_bytes long, n_records long, sha256 string"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest32(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(page_id, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {url} {digest}')}>"


def uri(url: str | None) -> str | None:
    return None if url is None else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def framed(fields: list[tuple], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def file_record(name: str) -> bytes:
    """The first record of a file, which describes it."""
    block = b"software: codelens\r\nformat: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return framed(fields, block)


def record(page_id, url, payload: bytes, n_bytes: int, digest: str, response: tuple | None) -> bytes:
    """A response, or a revisit of the ``response`` with that page id and address, whose payload is not needed."""
    is_revisit = response is not None
    refers_to, refers_to_url = response or (None, None)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri(url)),
        ("WARC-Page-ID", page_id),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if is_revisit else None),
        ("WARC-Refers-To", record_id(refers_to, refers_to_url, digest) if is_revisit else None),
        ("WARC-Refers-To-Target-URI", uri(refers_to_url)),
        ("WARC-Refers-To-Date", DATE if is_revisit else None),
        ("WARC-Refers-To-Page-ID", refers_to),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return framed(fields, block)


def members(row: dict) -> Iterator[tuple[bytes, int]]:
    """The compressed records of a planned row, and how often each is written."""
    about = row["page_id"], row["url"]
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    responses = 0
    if row["has_payload"]:
        payload = zstandard.decompress(row["payload"], max_output_size=row["n_bytes"])
        if digest32(payload) != digest:
            raise OSError(f"page {row['page_id']} changed while it was written")
        responses = 1 if row["repeats"] else row["copies"]
        yield gzip.compress(record(*about, payload, row["n_bytes"], digest, None), 6, mtime=0), responses
    if row["copies"] > responses:
        revisit = record(*about, b"", row["n_bytes"], digest, (row["last_id"], row["last_url"]))
        yield gzip.compress(revisit, 6, mtime=0), row["copies"] - responses


def planned(pages: DataFrame, least_bytes: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """The number of shards, and the rows to write: each stands for ``copies`` records at one place.

    Pages are read twice: for the order, which needs digests only, and for the
    payloads, which find their place by page, address and digest. Payloads move
    compressed, to be joined, and those of responses to their shard. A row with a
    payload is ``copies`` responses, or with ``repeats`` one and revisits of it. It may
    come several times, once for each task that met a copy.
    """
    html = F.coalesce("html", F.lit(""))
    page = [F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(html, 256).alias("content")]
    keys = ["page_id", "url", "content"]
    counted = pages.select(*page, F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    distinct = store(counted.groupBy(*keys, "digest", "n_bytes").agg(F.count("*").alias("all_copies")), "page-keys")
    equal = distinct.filter(F.col("n_bytes") >= least_bytes).groupBy("content", "n_bytes")
    equal = equal.agg(F.max(F.struct("page_id", "url")).alias("last"), F.sum("all_copies").alias("n")).filter("n > 1")
    is_last = F.col("last.page_id").eqNullSafe(F.col("page_id")) & F.col("last.url").eqNullSafe(F.col("url"))
    grouped = F.col("last").isNotNull()
    parts = distinct.join(equal, ["content", "n_bytes"], "left").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all_copies - 1) div {COPIES}"))).alias("copy_part")
    )
    kinds = parts.select(
        *keys, "digest", "n_bytes", "copy_part",
        F.least(F.lit(COPIES), F.col("all_copies") - F.col("copy_part") * COPIES).alias("copies"),
        (~grouped | (is_last & (F.col("copy_part") == 0))).alias("has_payload"),
        grouped.alias("repeats"),
        F.col("last.page_id").alias("last_id"),
        F.col("last.url").alias("last_url"),
    )
    payloads = F.when(F.col("has_payload"), F.when(F.col("repeats"), 1).otherwise(F.col("copies"))).otherwise(0)
    weighed = kinds.withColumn("weight", F.col("copies") * HEADER_BYTES + payloads * F.col("n_bytes"))
    places = running_totals(weighed, [*keys, "copy_part"], "weight", "place").withColumn("shard", F.floor(F.col("place") / shard_bytes))
    places = places.drop("weight", "copy_part")

    schema = "page_id2 long, url2 string, content2 string, payload binary"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, seen = zstandard.ZstdCompressor(3), set()
        for batch in batches:
            found = list(zip(*(column.to_pylist() for column in batch.columns[:3])))
            new = []
            for at, key in enumerate(found):
                if key not in seen:
                    seen = seen if len(seen) < SEEN else set()
                    seen.add(key)
                    new.append(at)
            batch = batch.take(pa.array(new, pa.int64()))
            shrunk = [compressor.compress((text.as_py() or "").encode()) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shrunk, pa.binary())], names=["page_id2", "url2", "content2", "payload"])

    same = [F.col(name).eqNullSafe(F.col(f"{name}2")) for name in keys]
    last = places.agg(F.max("shard")).first()[0]
    responses = places.filter("has_payload").join(pages.select(*page, "html").mapInArrow(shrink, schema), same)
    revisits = places.filter("NOT has_payload").withColumn("payload", F.lit(None).cast("binary"))
    return responses.select(revisits.columns).union(revisits), (last or 0) + 1


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under ``folder`` and returns the manifest, stored beside them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, inner = FileSystem.from_uri(folder)
        attempt, out, now, at, before = uuid.uuid4().hex, None, None, {}, None

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([at | {"file": name_of(at), "sha256": at["sha256"].hexdigest()}], schema=target)

        def name_of(file: dict) -> str:
            return f"{file['shard']:08d}-{file['seq']:05d}.warc.gz"

        def put(member: bytes) -> None:
            out.write(member)
            at["sha256"].update(member)
            at["n_bytes"] += len(member)

        target = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("temporary", pa.string()), ("file", pa.string()),
                            ("n_bytes", pa.int64()), ("n_records", pa.int64()), ("sha256", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                if row["place"] == before:
                    continue
                before = row["place"]
                for member, times in members(row):
                    for _ in range(times):
                        full = out is not None and at["n_bytes"] + len(member) > file_bytes
                        if now != row["shard"] or full:
                            if out is not None:
                                yield close()
                            seq = at["seq"] + 1 if now == row["shard"] else 0
                            now = row["shard"]
                            files.create_dir(f"{inner}/_temporary", recursive=True)
                            temporary = f"_temporary/{now:08d}-{seq:05d}-{attempt}"
                            out = files.open_output_stream(f"{inner}/{temporary}")
                            at = {"shard": now, "seq": seq, "temporary": temporary, "n_bytes": 0, "n_records": 0, "sha256": hashlib.sha256()}
                            put(gzip.compress(file_record(name_of(at)), 6, mtime=0))
                        put(member)
                        at["n_records"] += 1
        if out is not None:
            yield close()

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        files, inner = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if files.get_file_info(f"{inner}/{row['temporary']}").type == FileType.File:
                    files.move(f"{inner}/{row['temporary']}", f"{inner}/{row['file']}")
                if files.get_file_info(f"{inner}/{row['file']}").size != row["n_bytes"]:
                    raise OSError(f"{row['file']} is not the file that was written")
            yield batch

    rows, n_shards = planned(pages, least_bytes, shard_bytes)
    # As many tasks as shards, so that what a task reads does not grow with the input.
    dealt = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "place")
    written = store(dealt.mapInArrow(write, MANIFEST), "warc-attempts")
    spread_out(written, "file").mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest").drop("temporary")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive, one gzip member after another."""
    while content:
        member = zlib.decompressobj(31)
        raw = member.decompress(content)
        content = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def pages_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of pages, without the one that describes the file."""
    return (record for record in records(content) if record[0]["WARC-Type"] != "warcinfo")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's files, digests checked against the content."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    target = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, inner = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{inner}/{row['file']}", compression=None) as stream:
                    content = stream.read()
                if hashlib.sha256(content).hexdigest() != row["sha256"]:
                    raise OSError(f"{row['file']} is damaged")
                out = []
                for fields, block in pages_of(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}" or (kind == "response" and digest != digest32(payload)):
                        raise OSError(f"{fields['WARC-Record-ID']} in {row['file']} is damaged")
                    out.append({
                        "page_id": number(fields.get("WARC-Page-ID")),
                        "url": fields.get("WARC-Target-URI"),
                        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
                        "payload_digest": digest,
                        "record_type": kind,
                        "refers_to": number(fields.get("WARC-Refers-To-Page-ID")),
                        "html": payload.decode() if kind == "response" else None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return spread_out(manifest.select("file", "sha256"), "file").mapInArrow(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads these back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, least_bytes), folder)
