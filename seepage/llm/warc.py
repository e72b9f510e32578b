"""WARC archives: writing captures as transactions of records, and assembling them again.

A capture is written as three records, a request, a response (or a revisit of
an earlier one with an equal payload) and metadata; request and metadata name
the response in WARC-Concurrent-To. Every record is a gzip member of its own.
A task rolls its file by bytes, and a manifest committed by Spark names the
files that count, so what a lost task left behind is not read.

Reading parses every file as a stream, one record in memory at a time, and
joins the records of a transaction by their concurrent-to identifiers,
whichever record names the other and whichever file holds it, also over several
steps. Each capture becomes one nested row. Of several requests or metadata
records of one capture the first by identifier is in its row; the others, and
those that name no capture at hand, have rows of their own without a response.

A null payload is an empty one, a null URL an absent header. Characters that
would end a header line are percent-encoded in URLs. Equal payloads: of equal
ids one is the response. Null ids come before all others. A file cut short
gives the records before the cut and one row with ``error``. An empty table
gives an empty manifest and no rows. Very long payloads are held one at a time.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.graph import components
from seepage.operators.matching import lookup_join
from seepage.session import scratch, settle, spread

FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"
CRLF = b"\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_SPACE = uuid.UUID("6f1d3a52-8f0e-4c1b-9a55-2d7a1f3c0b11")  # any fixed one; names the identifiers of this module


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI as Spark names it, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlsplit(path).path)
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(kind: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{row}')}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return CRLF.join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def transaction(row: int, page_id, url: str | None, payload: bytes, first: int, first_url: str | None) -> list[bytes]:
    """The records of one capture; ``first`` is the row of the response with its payload, its own row if that is itself."""
    url, first_url = (u if u is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u) for u in (url, first_url))
    own = _record_id("response", row)
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    parts = urlsplit(re.sub(r"[\[\]]", "_", url or ""))
    asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    http = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if first == row:
        main = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, *http], answer + payload)
    else:
        main = _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, *http, ("WARC-Profile", PROFILE),
             ("WARC-Refers-To", _record_id("response", first)), ("WARC-Refers-To-Target-URI", first_url),
             ("WARC-Refers-To-Date", DATE)], answer)
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", row)), *shared, ("WARC-Concurrent-To", own),
         ("Content-Type", "application/http;msgtype=request")], asked.encode())
    facts = b"" if page_id is None else b"page-id: %d\r\n" % page_id
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", row)), *shared, ("WARC-Concurrent-To", own),
         ("Content-Type", "application/warc-fields")], facts)
    return [request, main, metadata]


def decided(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """(row, page_id, url, payload, first, first_url): each page's payload, and the row that responds with it.

    Of pages with equal payloads of ``least_bytes`` or more that is the one
    with the largest id. Equality is that of SHA-1, length and a second hash.
    """
    rows = spread(pages.select(id_col, url_col, payload_col)).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    key = F.concat_ws("/", F.sha1("payload"), F.octet_length("payload"), F.hex(F.xxhash64("payload")))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), "*", key.alias("key")), "payloads")
    large = rows.where(F.octet_length("payload") >= least_bytes)
    # Three plain maxima: a hash aggregate keeps fixed-width ones alone, and a hot payload is one row a task before the shuffle.
    last = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("page_id", F.lit(-2**63))).alias("last_id"))
    last = last.where("n > 1").drop("n")
    tied = lookup_join(large.select("key", "row", "url", F.coalesce("page_id", F.lit(-2**63)).alias("last_id")), last,
                       ["key", "last_id"])
    first = tied.groupBy("key").agg(F.min(F.struct("row", "url")).alias("first"))
    first = first.select("key", F.col("first.row").alias("first"), F.col("first.url").alias("first_url"))
    found = lookup_join(rows, first, "key", "left")
    return found.select("row", "page_id", "url", "payload", F.coalesce("first", "row").alias("first"), "first_url")


def _writer(folder: str, file_bytes: int):
    def run(batches):
        fs, root = filesystem(folder)
        out, name, records, written = None, None, 0, 0

        def ended():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [written]})

        for batch in batches:
            columns = [batch.column(c) for c in ("row", "page_id", "url", "payload", "first", "first_url")]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out, records, written = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                    ("WARC-Date", DATE), ("WARC-Filename", name),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    written += out.write(gzip.compress(info, 4, mtime=0))
                for record in transaction(*(c[i].as_py() for c in columns)):
                    written += out.write(gzip.compress(record, 4, mtime=0))
                    records += 1
                if written >= file_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()
    return run


def write_warc(pages: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES, **options) -> DataFrame:
    """Write a transaction for every page below ``folder``; returns the manifest (file, records, bytes)."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = decided(pages, **options)
    listed = f"{folder}/manifest"
    rows.mapInArrow(_writer(folder, file_bytes), MANIFEST).write.parquet(listed)
    return pages.sparkSession.read.schema(MANIFEST).parquet(listed)


RECORD = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, uri string, date string,"
          " headers map<string,string>, http_status int, http_headers string, payload binary, payload_bytes long,"
          " payload_digest string, fields map<string,string>, file string, error string")


def parsed(stream: io.BufferedIOBase):
    """(headers, block) of each record of an uncompressed stream, header names in lower case; several values are joined by a line feed."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        headers, name = {}, None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("headers end with the file")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:  # a folded line
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]}\n{value}" if name in headers else value
        size = int(headers.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise EOFError("a block ends with the file")
        yield headers, block


def _http(block: bytes) -> tuple[int | None, str, bytes]:
    """Status, header lines and payload of an HTTP answer; chunks are put together."""
    head, _, body = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\S+ (\d{3})", head)
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        whole, rest = [], body
        while rest:
            size, _, rest = rest.partition(CRLF)
            n = int(size.split(b";")[0] or b"0", 16)
            if not n:
                break
            whole.append(rest[:n])
            rest = rest[n + 2:]
        body = b"".join(whole)
    return int(status[1]) if status else None, head.decode("utf-8", "replace"), body


def _facts(headers: dict, block: bytes, file: str, payloads: bool) -> dict:
    kind, content = headers.get("warc-type", "").lower(), headers.get("content-type", "").lower()
    row = dict.fromkeys(c.split()[0] for c in RECORD.split(", "))
    row |= {"record_id": headers.get("warc-record-id"), "record_type": kind, "file": file, "headers": list(headers.items()),
            "concurrent_to": headers["warc-concurrent-to"].split("\n") if "warc-concurrent-to" in headers else [],
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date")}
    payload = block
    if content.startswith("application/http"):
        row["http_status"], row["http_headers"], payload = _http(block)
    elif content.startswith("application/warc-fields"):
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
        row["fields"] = list({k.strip().lower(): v.strip() for k, _, v in pairs}.items())
    if kind == "response":
        row |= {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if payloads else None}
    return row


def _reader(payloads: bool, at_once: int = 8 << 20):
    columns = [c.strip() for c in RECORD.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(c.split(" ", 1)[0], arrow[c.split(" ", 1)[1]]) for c in columns])

    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held, size = [], 0
                fs, path = filesystem(file)
                with fs.open_input_stream(path, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
                    try:
                        for headers, block in parsed(stream):
                            held.append(_facts(headers, block, file, payloads))
                            size += len(block) + 2000
                            if size >= at_once:
                                yield pa.RecordBatch.from_pylist(held, schema)
                                held, size = [], 0
                    except (EOFError, ValueError, OSError) as damage:
                        held.append({"record_type": "", "concurrent_to": [], "file": file, "error": str(damage)})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
    return run


def read_records(files: DataFrame) -> DataFrame:
    """All records of the files (file: path or URI), one row each; a file is one task's work."""
    return _read(files, True)


def _read(files: DataFrame, payloads: bool) -> DataFrame:
    files = files.select("file").distinct()
    return files.repartition(max(1, files.count())).mapInArrow(_reader(payloads), RECORD)


def archive_files(spark, folder: str) -> DataFrame:
    """(file) of a folder of archives that others wrote; their contents are not read here."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.lower("path").rlike(r"\.warc(\.gz)?$")).select(F.col("path").alias("file"))


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, record_type, refers_to, response, request, metadata.

    ``records`` are read several times: hand over a settled table. Columns it
    does not have are not in the nested rows either. Records that repeat an
    identifier are one record.
    """
    records = records.where("error IS NULL AND record_id IS NOT NULL")
    own = lambda *names: [c for c in names if c in records.columns]
    parts = own("record_id", "concurrent_to", "uri", "date", "headers")
    mains = records.where(F.col("record_type").isin("response", "revisit", "resource"))
    sides = records.where(F.col("record_type").isin("request", "metadata"))
    roots = mains.select(F.col("record_id").alias("capture")).distinct()
    links = records.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id <> other")
    either = links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    side_ids = sides.select("record_id").distinct()
    direct = either.join(side_ids, "record_id", "left_semi").join(
        roots.withColumnRenamed("capture", "other"), "other", "left_semi")
    direct = direct.groupBy("record_id").agg(F.min("other").alias("capture"))
    direct = settle(direct, "transactions")
    far = settle(side_ids.join(either.select("record_id").distinct(), "record_id", "left_semi").join(
        direct, "record_id", "left_anti"), "unresolved")
    if far.limit(1).count():  # linked to a capture through other records, if at all
        group = components(links, "record_id", "other")
        captures = group.join(roots.withColumnRenamed("capture", "node"), "node", "left_semi")
        captures = captures.groupBy("root").agg(F.min("node").alias("capture"))
        steps = far.join(group.withColumnRenamed("node", "record_id"), "record_id").join(captures, "root")
        direct = direct.unionByName(steps.select("record_id", "capture"))

    placed = sides.join(direct, "record_id", "left")
    firsts = placed.where("capture IS NOT NULL").groupBy("capture", "record_type").agg(F.min("record_id").alias("record_id"))
    placed = placed.join(firsts.select("record_id", "record_type", F.lit(True).alias("chosen")),
                         ["record_id", "record_type"], "left")
    capture = F.when(F.col("chosen"), F.col("capture"))
    request = F.when(F.col("record_type") == "request", F.struct(*parts, *own("http_headers")))
    metadata = F.when(F.col("record_type") == "metadata", F.struct(*parts, *own("fields")))
    rows = mains.select(
        F.col("record_id").alias("capture"), "record_id", "record_type", "refers_to",
        F.struct(*parts, *own("http_status", "http_headers", "payload", "payload_bytes", "payload_digest")).alias("response"),
        F.lit(None).cast(placed.select(request.alias("r")).schema["r"].dataType).alias("request"),
        F.lit(None).cast(placed.select(metadata.alias("m")).schema["m"].dataType).alias("metadata"))
    rows = rows.unionByName(placed.select(
        F.coalesce(capture, "record_id").alias("capture"), F.when(capture.isNull(), F.col("record_id")).alias("record_id"),
        F.when(capture.isNull(), F.col("record_type")).alias("record_type"), request.alias("request"), metadata.alias("metadata")),
        allowMissingColumns=True)
    # Three rows a capture at most, so the groups are small whatever the archive holds.
    return rows.groupBy("capture").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("record_id", "record_type", "refers_to", "response", "request", "metadata")]
    ).drop("capture")


def captures(spark, folder: str, *, columns: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """The captures of a folder of archives, or of the files of a manifest, whose records have to be there in full.

    ``columns`` are those of RECORD to carry into the nested rows, all of them by default.
    """
    needed = ["record_id", "record_type", "concurrent_to", "refers_to", "error"]
    payloads = columns is None or "payload" in columns

    def read_records(files):
        rows = _read(files, payloads)
        return rows if columns is None else rows.select(*needed, *[c for c in columns if c not in needed])
    if files is None:
        return assembled(settle(read_records(archive_files(spark, folder)), "records"))
    named = files.select(F.concat(F.lit(folder + "/"), "file").alias("file"))
    records = settle(read_records(named), "records")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read = records.agg(F.count_if(F.expr("error IS NULL AND record_type <> 'warcinfo'")), F.first("error", ignorenulls=True)).first()
    if read[0] != written:
        raise ValueError(f"{read[0]} records of {written}: {read[1]}")
    return assembled(records)


def digests(rows: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures; a revisit has those of what it refers to.

    What a revisit refers to is found by its record's identifier, and named by the page id of that capture's metadata.
    """
    plain = rows.where("response IS NOT NULL").select(
        F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"), "record_id", "record_type",
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("refers_to").alias("target"))
    plain = settle(plain, "captures")
    again = plain.where("record_type = 'revisit'").select("page_id", "record_type", "target")
    wanted = again.select("target").distinct()
    known = plain.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = lookup_join(again, known.join(wanted, "target", "left_semi"), "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = plain.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.select(*columns).unionByName(again.select(*columns))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the pages into the shared folder, read the archives back, and give each page's digests."""
    folder = scratch(pages.sparkSession, "warc")
    files = write_warc(pages, folder, **options)
    return digests(captures(pages.sparkSession, folder, columns=["payload_bytes", "payload_digest", "fields"], files=files))
