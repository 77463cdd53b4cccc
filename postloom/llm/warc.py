"""WARC archives: written with one gzip member per record, read back in byte ranges.

*Writing.*  Each task writes an archive of its own and reports it; only reported archives count, so
a lost or repeated task leaves nothing half-read.  Of records with equal payloads one is a
response, the others are revisits that refer to it.

*Reading.*  Archives are cut into byte ranges, one task each.  A task looks for the gzip magic in
its range, tries to decode a record header at each candidate, and owns the records that start in
its range; it reads beyond the end for the last of them.
"""

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch, is_small

TASKS_PER_CORE = 32
RANGE_BYTES = 8 << 20
LEAST_SHARED = 100
MAGIC = b"\x1f\x8b\x08"
PEEK = 1 << 16
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FOUND = (
    "record_id string, record_type string, target_uri string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to string, archive string, position bigint"
)


def plan_revisits(pages, least=LEAST_SHARED):
    """Add ``payload_bytes, payload_digest, refers_to`` to ``pages (page_id, url, html)``.

    Of equal payloads of at least ``least`` bytes the row with the smallest page_id is the response
    that the others refer to.  Null html is empty.  Of rows that repeat this page_id all are
    responses, and so are rows with a null page_id when no other is there.
    """
    scratch = Scratch(pages.sparkSession, "warc-plan")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("bigint"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = scratch.save(shared.where("n > 1").drop("n"), "shared")
    shared = F.broadcast(shared) if is_small(shared, 80) else shared
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()),
               F.col("first")).alias("refers_to"))


def record_name(page_id):
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def record_member(page_id, url, html, size, digest, refers_to):
    """One record as a gzip member."""
    payload = html.encode()
    clean = "".join(c if " " < c else "%%%02X" % ord(c) for c in url or "about:blank")
    kind, block = ("response", HTTP + payload) if refers_to is None else ("revisit", HTTP)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_name(refers_to)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0)


def write_archives(planned, folder):
    """Write ``planned`` rows below ``folder``; gives ``archive, bytes, records`` of each file."""

    def task(batches):
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(name, compression=None)
                member = record_member(*row)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"archive": [name], "bytes": [size], "records": [records]})

    return planned.mapInArrow(task, "archive string, bytes bigint, records bigint")


def header_at(file, position, end):
    """``(version, fields)`` if a record starts at ``position``, else None.

    Once the member starts with ``WARC/`` its header may have any length.
    """
    file.seek(position)
    decoder, head, taken, searched = zlib.decompressobj(31), bytearray(), 0, 0
    while (found := head.find(b"\r\n\r\n", searched)) < 0 and not decoder.eof:
        searched = max(0, len(head) - 3)
        data = decoder.unconsumed_tail
        if not data:
            data = file.read(min(4096, end - position - taken))
            taken += len(data)
        if not data:
            break
        try:
            head += decoder.decompress(data, CHUNK)
        except zlib.error:
            return None
        if not b"WARC/".startswith(head[:5]):
            return None
    if not head.startswith(b"WARC/") or found < 0:
        return None
    head = bytes(head[:found])
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return lines[0], fields


def member_at(file, position, end):
    """The decoded member at ``position`` and the place after it."""
    file.seek(position)
    decoder, parts, at = zlib.decompressobj(31), [], position
    while not decoder.eof:
        data = file.read(min(CHUNK, end - at))
        if not data:
            raise ValueError(f"the archive ends within the record at {position}")
        at += len(data)
        parts.append(decoder.decompress(data))
    return b"".join(parts), at - len(decoder.unused_data)


def records_from(file, start, stop, end):
    """``(position, fields, block)`` of the records that start in ``start`` to ``stop``."""
    at = start
    while at < stop:
        file.seek(at)
        window = file.read(min(PEEK, end - at))
        place = window.find(MAGIC)
        if place < 0:
            if len(window) <= len(MAGIC) - 1 or at + len(window) >= end:
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += place
        if at >= stop:
            return
        head = header_at(file, at, end)
        if head is None:
            at += 1
            continue
        whole, after = member_at(file, at, end)
        block = whole.split(b"\r\n\r\n", 1)[1]
        yield at, head[1], block[:int(head[1].get("content-length", len(block)))]
        at = after


def read_archives(archives, folder, range_bytes=RANGE_BYTES):
    """All records of ``archives (archive, bytes)``, read in ranges of ``range_bytes``.

    The digest and size of a response are taken from its payload and must agree with its header;
    those of a revisit are the header's.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes))
    ranges = archives.select("archive", "bytes", F.explode(starts).alias("start"))
    # An explicit number of tasks: the rows are few and short, and would be joined into one.
    cores = archives.sparkSession.sparkContext.defaultParallelism
    ranges = ranges.repartition(max(1, min(ranges.count(), TASKS_PER_CORE * cores)))

    def task(batches):
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                with files.open_input_file(name) as file:
                    rows, held = [], 0
                    for at, fields, block in records_from(
                            file, start, min(size, start + range_bytes), size):
                        rows.append(record_row(name, at, fields, block))
                        held += len(block)
                        if held > CHUNK * 16:
                            yield rows_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield rows_batch(rows)

    return ranges.mapInArrow(task, FOUND)


def check_counts(found, archives):
    """Fail if an archive gave another number of records than its manifest row says."""
    counts = found.groupBy("archive").agg(F.count("*").alias("read"))
    wrong = archives.join(counts, "archive", "left").where(
        F.coalesce("read", F.lit(0)) != F.col("records")).select("archive", "records", "read")
    for name, wanted, read in wrong.limit(1).collect():
        raise ValueError(f"{name} gave {read or 0} records of {wanted}")


def record_row(archive, position, fields, block):
    payload = block.split(b"\r\n\r\n", 1)[-1]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields.get("warc-type", "")
    size = len(payload)
    if kind == "revisit":
        size = int(fields.get("x-payload-length", 0))
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {archive} at {position} differs from its digest")
    return (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"),
            payload, size, digest, fields.get("warc-refers-to"), archive, position)


def rows_batch(rows):
    names = [part.split()[0] for part in FOUND.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(),
             pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def page_of(name):
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def roundtrip(pages, least=LEAST_SHARED, range_bytes=RANGE_BYTES):
    """Write ``pages`` as archives and read them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; archives stay in the shared
    folder.  A null html is empty.  Of equal payloads the row with the smallest page_id is the
    response; rows that repeat a page_id, or have none, are records of their own.  Other columns are
    not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    folder = folder if ":/" in folder else f"file://{folder}"
    archives = scratch.save(write_archives(plan_revisits(pages, least), folder), "manifest")
    records = read_archives(archives, folder, range_bytes).drop("payload")
    records = scratch.save(records, "records")
    check_counts(records, archives)
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"))
