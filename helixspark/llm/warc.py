"""WARC archives as a PySpark data source, and writing pages to archives with revisit records.

Reading: ``spark.read.format("warc").load(path)``. Partitions are planned from the folder's manifests, one of each
committed job: an archive is cut at record starts about every SPLIT bytes; archives of other programs (.warc and
.warc.gz without an entry in any manifest, and not named as a task names its file) are a partition each. Predicates on record_type (=, in) and on header columns (=, >=, >, <=, <, starts with)
are pushed down and decided on a record's header; the payload of a record that fails, or any payload if the
asked schema has no payload column, is skipped without being read. Header pushdown needs
``spark.sql.python.filterPushdown.enabled``.

Writing: each task writes one file under a name of its own, and only files of committed tasks enter the job's
manifest, so retried and speculative tasks do no harm. Jobs that append leave each other's files and manifests;
one that overwrites deletes, once its own manifest is written, all archives that were to be read before. Paths may be of any file system pyarrow knows.

Defined results for ``archive_pages``: a null html is an empty payload; of records with equal payloads of at
least 1000 bytes that with the largest page_id is a response and the others revisit it; rows repeating that
page_id are responses too; rows without page_id are written but never referred to; an empty table gives an
archive without records.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from helixspark.llm.common import bounded_batches, scratch, shared_dir, without

SPLIT, LEAST_SHARED, BROADCAST_BYTES = 32 << 20, 1000, 32 << 20
#: Bytes of a row of a digest and an id when it is broadcast.
SHARED_BYTES = 160
#: Names of manifests (without a job's id: of archives written before each job had its own) and of the files of tasks.
MANIFEST, TASK_FILE = re.compile(r"_manifest(-[0-9a-f]{32})?\.json"), re.compile(r"part-[0-9a-f]{32}\.warc")
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length bigint, payload binary"
)
#: column: header it comes from
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else "file://" + path)


def stored(fs: pafs.FileSystem, root: str) -> tuple[list[str], list[dict], list[str]]:
    """Of a folder: the names of its manifests, their entries, and the names of other programs' archives."""
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File)
    manifests, entries = [n for n in names if MANIFEST.fullmatch(n)], []
    for name in manifests:
        with fs.open_input_stream(f"{root}/{name}") as f:
            entries += json.loads(f.read())["files"]
    known = {e["file"] for e in entries}
    foreign = [n for n in names if re.search(r"\.warc(\.gz)?$", n) and n not in known and not TASK_FILE.fullmatch(n)]
    return manifests, entries, foreign


def header_value(text: str) -> str:
    """A header is one line: line ends are percent-encoded."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, uri: str | None, digest: str | None, length: int, refers_to: str | None, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {header_value(record_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {header_value(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}"] if digest else []
    lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []
    lines += ["Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {length}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_headers(f) -> dict[str, str] | None:
    """The next record's headers (names lower-cased), or None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out, last = {}, ""
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line goes on
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def row_of(headers: dict[str, str]) -> dict:
    out = {c: headers.get(h) for c, h in HEADERS.items()}
    digest = out["payload_digest"]
    out["payload_digest"] = digest.partition(":")[2] if digest and ":" in digest else digest
    length = out["payload_length"] or headers.get("content-length")
    out["payload_length"] = int(length) if length and length.isdigit() else None
    return out


def holds(test: tuple, row: dict) -> bool:
    op, column, value = test
    x = row[column]
    if x is None:
        return False
    return {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "starts": lambda: x.startswith(value)}[op]()


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int | None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters):
        ops = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}
        for f in filters:
            op = ops.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((op, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Part(self.path, 0, None)]
        _, entries, foreign = stored(fs, root)
        out = []
        for entry in entries:
            cuts = [*entry["cuts"], entry["bytes"]]
            out += [Part(f"{self.path}/{entry['file']}", a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        out += [Part(f"{self.path}/{name}", 0, None) for name in foreign]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an archive without records has no partition
            return
        fs, file = opened(part.file)
        schema = pa.schema([pa.field(c, {"payload": pa.binary(), "payload_length": pa.int64()}.get(c, pa.string())) for c in self.columns])
        wants = "payload" in self.columns
        rows, held = [], 0
        raw = fs.open_input_file(file)
        with io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if file.endswith(".gz") else io.BufferedReader(raw, 1 << 20) as f:
            if part.start:
                f.seek(part.start)
            # the four bytes that end a record are still ahead after its payload
            while (part.end is None or f.tell() + 4 < part.end) and (headers := read_headers(f)) is not None:
                size, row = int(headers.get("content-length") or 0), row_of(headers)
                if wants and all(holds(t, row) for t in self.tests):
                    row["payload"] = f.read(size)
                    held += size
                    rows.append(row)
                else:
                    f.seek(size, 1)
                    if not wants and all(holds(t, row) for t in self.tests):
                        rows.append(row)
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    file: str
    bytes: int
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc", 0, [0]
        with fs.open_output_stream(f"{root}/{name}") as f:
            for b in batches:
                for r in b.to_pylist():
                    if at - cuts[-1] >= SPLIT:
                        cuts.append(at)
                    at += f.write(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload_length"], r["refers_to"], r["payload"] or b""))
        return Written(name, at, cuts)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"file": m.file, "bytes": m.bytes, "cuts": m.cuts} for m in messages if m is not None and m.bytes]
        manifests, entries, foreign = stored(fs, root) if self.overwrite else ([], [], [])
        manifest = f"_manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/{manifest}") as f:
            f.write(json.dumps({"files": files}).encode())
        for name in [*manifests, *[e["file"] for e in entries], *foreign]:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.file}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame) -> DataFrame:
    """The records of pages, in the data source's columns. Only digests that occur twice or more are joined
    back, by a broadcast if they take at most BROADCAST_BYTES, else by a shuffled join whose hot digests Spark splits."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = without(pages, "payload", "digest", "n").select("page_id", "url", payload.alias("payload"))
    full = full.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("bigint")})
    shared = full.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1 and kept is not null").select("digest", "kept")
    # without a shuffle of payloads where the digests are few enough to broadcast
    shared = scratch(shared, "shared")
    shared = F.broadcast(shared) if shared.count() * SHARED_BYTES <= BROADCAST_BYTES else shared
    revisits = (F.col("kept").isNotNull() & F.coalesce(F.col("page_id") != F.col("kept"), F.lit(True))) & (F.col("n") >= LEAST_SHARED)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return full.join(shared, "digest", "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(revisits, urn(F.col("kept"))).alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("n").alias("payload_length"),
        F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write a record for each page; returns the archive's folder (a new one below the shared folder)."""
    spark = pages.sparkSession
    register(spark)
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An archive's records, or only some columns of them: without ``payload`` no payload is read."""
    register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    reader = spark.read.format("warc")
    return (reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else reader).load(path)


def archive_digests(spark: SparkSession, path: str) -> DataFrame:
    """``page_digests`` of an archive. Revisits say all that is asked in their headers, so they are read by a pushed predicate and without the
    payload column; payloads are read of the records that a second pushed predicate takes for responses."""
    heads = read_archive(spark, path, [c for c in HEADERS]).where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    return page_digests(heads).unionByName(page_digests(read_archive(spark, path).where("record_type = 'response'")))


def page_digests(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read back. A response's
    size and digest are taken from the payload as read, a revisit's from its header."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    return archive.select(
        page(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to"))).alias("refers_to"),
    )
