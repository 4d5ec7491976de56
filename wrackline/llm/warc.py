"""WARC archives of pages: written, normalised to one gzip member a record with an offset index beside each, and read back.

Archives arrive as monolithic gzip files: one stream over all records, which can only be read from its start. The
normaliser inflates such a stream once, in pieces, and rewrites every record as a gzip member of its own; beside the new
archive it writes a sidecar index with one JSON line a record (offset, length, headers). From then on any record is read by
one seek. Files that are members already, a mixture, or plain text pass through the same way. A task that copies holds a piece of one
record at a time (with strict=False one record, packed); the archive is the unit of work.

Workers open files through pyarrow.fs, so the folder may be in any store that it knows (file, hdfs, s3, gs, abfs). A file's
name is new for each attempt of a task and is returned in a row, so what a lost or repeated task left behind is never read.

Of pages with equal payloads of `least` bytes or more, that with the largest page_id is written as `response`, the others
as `revisit` of it, without the payload. Repeated payloads are found on digests, counted before they are shuffled; a hot
payload is one row there, and where there are too many to broadcast, rows meet it in salted parts.

Defined results: null html is an empty payload; empty and short payloads are all responses, however often they occur; very
long ones are written and copied in pieces; rows that repeat the response's page_id and its payload are responses, too; a
null page_id loses against any other, and equal payloads without any page_id are all responses; a null url leaves the
header out, control characters and blanks in it are percent-encoded; an empty table gives no archive and an empty result.
Only the three named columns are read. A damaged archive raises; with strict=False the whole records before the damage
are kept and `damage` says what was found. A record without Content-Length is damage.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, shared_folder, stored, table

LEAST = 1000
#: An archive is closed after so many bytes of records; a record larger than that has one of its own.
ARCHIVE_BYTES = 64 << 20
#: Repeated payloads are broadcast up to this many (some 120 bytes each).
BROADCAST_REPEATS = 200_000
SALTS, PIECE, BATCH_BYTES = 64, 1 << 20, 8 << 20
ARCHIVES = "archive string, n_records bigint, n_bytes bigint, damage string"
INDEX = "archive string, offset bigint, length bigint, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string"
RECORDS = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
_ID = "urn:x-page:"
#: Header names by column, as the format has them; the payload's length of a revisit is an extension.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To",
}


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest (SHA-1) and refers_to (NULL for responses) of every row."""
    payload = F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    key = F.sha2("payload", 256)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    long = F.octet_length("payload") >= least
    parts = stored(rows.where(long).groupBy(key.alias("key"), salt.alias("salt")).agg(F.max("page_id").alias("top"), F.count("*").alias("n")), "payloads")
    repeats = stored(parts.groupBy("key").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where((F.col("n") > 1) & F.col("top").isNotNull()).select("key", "top"), "repeats")
    keyed = rows.withColumn("key", F.when(long, key))
    if repeats.count() <= BROADCAST_REPEATS:
        found = keyed.join(F.broadcast(repeats), "key", "left")
    else:
        salted = parts.select("key", "salt").join(repeats, "key")
        # rows that can't repeat have keys of their own, so that they don't meet in one task
        own = F.coalesce("key", F.uuid())
        found = keyed.withColumns({"key": own, "salt": salt}).join(salted, ["key", "salt"], "left")
    return found.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def _urn(page_id: str | None) -> str:
    return f"<{_ID}{urllib.parse.quote(page_id, safe='')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_id_of(urn: Column) -> Column:
    """The page_id in a record ID as text; NULL if it has none."""
    found = F.regexp_extract(urn, f"^<{_ID}(.*)>$", 1)
    return F.when(urn.startswith(f"<{_ID}"), F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def _record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> tuple[bytes, bytes]:
    """Header and block of a record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode(), block


def _row(schema: str, **values: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({n: pa.array(values[n], kinds[t]) for n, t in (f.split() for f in schema.split(", "))})


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes records() as archives of one gzip stream each and returns a stored table of them (ARCHIVES); each partition writes its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _at(folder)
        fs.create_dir(base, recursive=True)
        raw = out = None
        name, count, size = "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            raw.close()
            return _row(ARCHIVES, archive=[f"{folder}/{name}"], n_records=[count], n_bytes=[size], damage=[None])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                if out is not None and size >= archive_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    raw = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=level, mtime=0)
                head, block = _record(page_id, url, payload, digest, refers_to, date)
                out.write(head)
                out.write(block)
                out.write(b"\r\n\r\n")
                count, size = count + 1, size + len(head) + len(block) + 4
        if out is not None:
            yield close()

    typed = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return stored(typed.mapInArrow(run, ARCHIVES), "archives")


class _Inflated(io.RawIOBase):
    """A gzip stream of any number of members, inflated a piece at a time; what comes before damage is delivered first."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.unpack, self.rest = raw, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while True:
            if self.unpack is None:
                self.rest = (self.rest or self.raw.read(PIECE)).lstrip(b"\0")  # padding between members
                if not self.rest:
                    if not (more := self.raw.read(PIECE)):
                        return 0
                    self.rest = more
                    continue
                self.unpack = zlib.decompressobj(31)
            given = self.rest or self.raw.read(PIECE)
            data = self.unpack.decompress(given, len(buffer))
            if self.unpack.eof:
                self.rest, self.unpack = self.unpack.unused_data, None
            else:
                self.rest = self.unpack.unconsumed_tail
                if not given and not data:
                    raise EOFError("the stream ends within a gzip member")
            if data:
                buffer[: len(data)] = data
                return len(data)


def _read_head(stream: io.BufferedIOBase) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header as it stands and by lower-case name; None at the end. Blank lines before it are skipped."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    lines, fields, last = [line], {}, None
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the stream ends within a header")
        lines.append(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line goes on
            fields[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    lines.append(line)
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a record has no Content-Length")
    return b"".join(lines), fields


def _entry(fields: dict[str, str]) -> dict:
    out = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    out["payload_bytes"] = int(out["payload_bytes"]) if (out["payload_bytes"] or "").isdigit() else None
    out["payload_digest"] = (out["payload_digest"] or "").removeprefix("sha1:") or None
    return out


def _normalise_one(archive: str, folder: str, level: int, strict: bool) -> dict:
    fs, path = _at(archive)
    to, base = _at(folder)
    to.create_dir(base, recursive=True)
    name, count, at, damage = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
    with fs.open_input_file(path) as raw, to.open_output_stream(f"{base}/{name}", compression=None) as out, to.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        stream = io.BufferedReader(_Inflated(raw) if packed else raw, PIECE)
        while True:
            spool = io.BytesIO()
            try:
                found = _read_head(stream)
                if found is None:
                    break
                head, fields = found
                left, entry = int(fields["content-length"]), _entry(fields)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                spool.write(pack.compress(head))
                start, direct = at, False
                while left:
                    piece = stream.read(min(left, PIECE))
                    if not piece:
                        raise ValueError("the stream ends within a record")
                    left -= len(piece)
                    spool.write(pack.compress(piece))
                    if strict and spool.tell() > PIECE:  # a long record isn't held back: damage raises anyway
                        out.write(spool.getvalue())
                        at += spool.tell()
                        spool = io.BytesIO()
                spool.write(pack.compress(b"\r\n\r\n") + pack.flush())
            except (ValueError, EOFError, OSError, zlib.error) as e:
                if strict:
                    raise ValueError(f"{archive}, after {count} records: {e}") from e
                damage = str(e)
                break
            out.write(spool.getvalue())
            at += spool.tell()
            index.write((json.dumps({"offset": start, "length": at - start} | entry) + "\n").encode())
            count += 1
    return {"archive": [f"{folder}/{name}"], "n_records": [count], "n_bytes": [at], "damage": [damage]}


def _dealt(archives: DataFrame) -> DataFrame:
    """One archive a task, or a few where there are very many."""
    return archives.repartition(max(1, min(archives.count(), 50_000)))


def normalise(archives: DataFrame, folder: str, level: int = 6, strict: bool = True) -> DataFrame:
    """Rewrites every archive of a table with a column `archive` into folder, a gzip member a record, with its index at `<archive>.idx`. Returns a stored table (ARCHIVES) of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                yield _row(ARCHIVES, **_normalise_one(archive, folder, level, strict))

    return stored(_dealt(archives.select("archive")).mapInArrow(run, ARCHIVES), "archives")


def read_index(archives: DataFrame) -> DataFrame:
    """The sidecar indexes of normalised archives (INDEX), in the archives' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = _at(archive)
                with fs.open_input_stream(path + ".idx", compression=None) as raw:
                    lines = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8")
                    while rows := [json.loads(line) | {"archive": archive} for line, _ in zip(lines, range(10_000), strict=False)]:
                        yield _row(INDEX, **{n: [r.get(n) for r in rows] for n in names})

    return _dealt(archives.select("archive")).mapInArrow(run, INDEX)


def fetch(index: DataFrame) -> DataFrame:
    """The records that index rows (archive, offset, length) point at (RECORDS), each read by a seek; payload is NULL for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        is_open, raw, rows, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != is_open:
                    if raw is not None:
                        raw.close()
                    fs, path = _at(archive)
                    raw, is_open = fs.open_input_file(path), archive
                raw.seek(offset)
                stream = io.BytesIO(zlib.decompress(raw.read(length), 31))
                _, fields = _read_head(stream)
                block = stream.read(int(fields["content-length"]))
                entry = _entry(fields)
                if fields.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                entry["payload"] = None if entry["record_type"] == "revisit" else block
                rows.append(entry)
                held += len(block)
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield _row(RECORDS, **{n: [r[n] for r in rows] for n in names})
                    rows, held = [], 0
        if rows:
            yield _row(RECORDS, **{n: [r[n] for r in rows] for n in names})

    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    written = write_monolithic(records(pages), f"{folder}/monolithic")
    normal = normalise(written, f"{folder}/normal")
    drop_stored(written)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/monolithic")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    kind = pages.schema["page_id"].dataType
    revisit = F.col("record_type") == "revisit"
    return fetch(read_index(normal)).select(
        page_id_of(F.col("record_id")).cast(kind).alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to")).cast(kind).alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
