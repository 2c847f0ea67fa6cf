"""WARC archives: writing captures, reading archives back and resolving revisit records.

Captures with equal payloads are found by shuffling their headers (digest, length, id), never the
payloads. The capture with the largest id becomes the response; the others become revisit records
that refer to it. Archives are gzip files with one member per record, each rolled at ``ROLL`` bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import lookup_join

from .common import attempt_path, file_system, publish, small_batches

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 1000
#: A task starts a new archive beyond this many compressed bytes.
ROLL = 256 << 20
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, records long, bytes long"
_RECORD = (
    "record_id string, record_type string, page_id long, url string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to_record string, file string"
)
_RECORD_COLUMNS = [c.split()[0] for c in _RECORD.split(", ")]


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same capture, so that a task that runs twice writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _one_line(value: str) -> str:
    """A header value: line breaks of a URL would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def render(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, original: int | None
) -> bytes:
    """One record; ``original`` is the id of the capture that a revisit, which has no payload, refers to."""
    block = _http(size)
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", WARC_DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if original is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest))]
    return _head(fields, len(block)) + block + b"\r\n\r\n"


def originals(captures: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, original) of every payload that several captures share; ``captures`` has headers only.

    Equal headers are combined before the shuffle, so a payload of a third of all captures is a
    row per task. A payload whose captures all have null ids has no original.
    """
    return (
        captures.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("original").isNotNull())
        .select("payload_digest", "original")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = LEAST_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
) -> DataFrame:
    """Write one record per row into gzip archives in ``folder``; returns the manifest (file, records, bytes).

    Rows whose payload of at least ``least`` bytes has a capture with a larger id become revisits of
    the largest. A null payload is empty, a null id smaller than any other, a null URL left out.
    Rows that repeat the largest id are all responses. Other columns are not read. An empty table
    writes an empty manifest.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = originals(rows.select("page_id", "payload_digest", "payload_bytes"), least)
    marked = lookup_join(rows, shared, "payload_digest")
    again = (F.col("payload_bytes") >= least) & ~F.col("original").eqNullSafe(F.col("page_id"))
    marked = marked.withColumn("original", F.when(again, F.col("original")))
    return _write(marked.withColumn("payload", F.when(F.col("original").isNull(), F.col("payload"))), folder)


def _write(marked: DataFrame, folder: str) -> DataFrame:
    """Write rows of which those with an ``original`` are revisits, and return the manifest."""
    spark = marked.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = file_system(folder)
        out, done, number, records, size = None, [], 0, 0, 0

        def close() -> None:
            out.close()
            publish(fs, attempt, f"{root}/{name}")
            done.append((name, records, size))

        for batch in small_batches(batches, 64):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{number:04d}.warc.gz"
                    attempt = attempt_path(root, name, task.taskAttemptId())
                    out = fs.open_output_stream(attempt, compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(render(*row)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ROLL:
                    close()
                    out, number, records, size = None, number + 1, 0, 0
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), d)) for d in done])

    records = marked.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "original")
    records.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive; header names in lower case."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields, last = {}, None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("cut off WARC record")
        yield fields, block


def _digest(text: str) -> str | None:
    """Bare lower-case hex of a sha1 digest in either notation."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1" or not value:
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def _row(fields: dict[str, str], block: bytes, name: str, keep: bool) -> tuple | None:
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "resource"):
        return None
    page, refers = fields.get("x-page-id"), fields.get("warc-refers-to")
    common = (fields.get("warc-record-id"), "revisit" if kind == "revisit" else "response", int(page) if page else None)
    said = _digest(fields.get("warc-payload-digest", ""))
    if kind == "revisit":
        return (*common, fields.get("warc-target-uri"), None, None, said, refers, name)
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    digest = hashlib.sha1(payload).hexdigest()
    if said and said != digest:
        raise ValueError(f"payload of {common[0]} does not have its digest")
    return (*common, fields.get("warc-target-uri"), payload if keep else None, len(payload), digest, None, name)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every response, resource and revisit record of the archives that the manifest in ``folder`` names.

    A task per archive streams its records. Payload digests are verified; a response whose payload
    differs from its digest raises ValueError. ``payloads=False`` leaves the payloads out. Archives of an
    empty table give no rows; a folder without a manifest is an error.
    """
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    files = files.repartition(spark.sparkContext.defaultParallelism * 4, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        schema = pa.schema(
            [
                (c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                for c in _RECORD.split(", ")
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                    rows, held = [], 0
                    for fields, block in parse(io.BufferedReader(stream)):
                        row = _row(fields, block, name, payloads)
                        if row is None:
                            continue
                        rows.append(row)
                        held += len(row[4] or b"")
                        if len(rows) == 2000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(_RECORD_COLUMNS, r)) for r in rows], schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(_RECORD_COLUMNS, r)) for r in rows], schema)

    return files.mapInArrow(read, _RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Headers with each revisit joined to its response: length and id of the full payload.

    A revisit names its response by record id; where that is unknown, the response with the same
    digest and the largest id is taken. A revisit without any response keeps null there. Payloads
    do not travel.
    """
    heads = records.select("record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to_record")
    responses = heads.where("record_type = 'response'")
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes")
    named = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.max_by("payload_bytes", "page_id").alias("bytes_r"),
        F.max("page_id").alias("page_r"),
        F.count(F.lit(1)).alias("found"),
    )
    # Sizes are guessed from the short list of archives, so joins that must shuffle say so.
    met = revisits.join(named.hint("merge"), "refers_to_record", "left")
    lost = met.where(F.col("found").isNull()).drop("bytes_r", "page_r", "found")
    by_digest = responses.where(F.col("payload_digest").isNotNull()).groupBy("payload_digest").agg(
        F.max_by("payload_bytes", "page_id").alias("bytes_r"), F.max("page_id").alias("page_r")
    )
    columns = ["record_type", "page_id", "url", "payload_digest", F.col("bytes_r").alias("payload_bytes"), F.col("page_r").alias("refers_to")]
    solved = met.where(F.col("found").isNotNull()).select(*columns)
    rest = lost.join(by_digest.hint("merge"), "payload_digest", "left").select(*columns)
    plain = responses.select(
        "record_type", "page_id", "url", "payload_digest", "payload_bytes", F.lit(None).cast("long").alias("refers_to")
    )
    return plain.unionByName(solved).unionByName(rest)


def rewrite_archives(spark: SparkSession, folder: str, out: str, least: int = LEAST_BYTES) -> DataFrame:
    """Read archives with revisits, deduplicate all captures anew and write them with fresh headers.

    Revisits get the URL and id of their own capture and are written against the response chosen
    now. A revisit without a response in the archives cannot be resolved and raises ValueError in
    its task.
    """
    captures = resolve_revisits(read_archives(spark, folder, payloads=False))
    marked = captures.join(originals(captures, least).hint("merge"), "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & ~F.col("original").eqNullSafe(F.col("page_id"))
    marked = marked.withColumn("original", F.when(again, F.col("original"))).drop("refers_to", "record_type")
    stored = read_archives(spark, folder).where("record_type = 'response'")
    bodies = stored.groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    kept = marked.where(F.col("original").isNull()).join(bodies.hint("merge"), "payload_digest", "left")
    lost = F.raise_error(F.concat(F.lit("no response holds payload "), "payload_digest"))
    kept = kept.withColumn("payload", F.coalesce("payload", lost.cast("binary")))
    revisits = marked.where(F.col("original").isNotNull()).withColumn("payload", F.lit(None).cast("binary"))
    return _write(kept.unionByName(revisits), out)
