"""Sources, sinks and the stream, over files that Spark writes from the test tables."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage import rules as R
from seepage.functions import text as X
from seepage.functions.pieces import pieces
from seepage.operators import scan as S
from seepage.operators import score as C
from seepage.plans import duck as D
from seepage.plans.derived import DERIVED
from seepage.plans.join_queries import REPORT_SQL, report
from seepage.plans.registry import query
from seepage.session import scratch
from seepage.sources import files, sinks
from seepage.streaming import monitor as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = "acme.example.com"


@query("scan_text_dump", f"SELECT {D.strip('line')} AS line FROM dump_lines WHERE {D.strip('line')} <> ''", ("dump_lines",))
def scan_text_dump(t):
    base = scratch(t.spark, "dump")
    lines = t.dump_lines
    plain = F.col("source_file").rlike("part[0-7]\\.")
    lines.where(plain).select(F.concat(F.lit("  "), "line").alias("value")).write.text(f"{base}/a")
    lines.where(~plain).select("line").write.option("compression", "gzip").text(f"{base}/b/c")
    return files.scan_text_dump(t.spark, base).select("line")


@query("load_wordlist", "SELECT word FROM host_words", ("host_words",))
def load_wordlist(t):
    path = scratch(t.spark, "words")
    t.host_words.select(F.concat(F.lit(" "), "word", F.lit("\t\n  ")).alias("value")).write.text(path)
    return files.load_wordlist(t.spark, path)


@query("ct_load", "SELECT * FROM ct_entries", ("ct_entries",))
def ct_load(t):
    path = scratch(t.spark, "ct")
    t.ct_entries.write.json(path)
    return files.load_certificate_log(t.spark, path, multi_line=False)


#: Entries of a file that holds a JSON array, in the mean: an array is built and read as one row.
PER_ARRAY = 7_500


@query("ct_load_arrays", "SELECT * FROM ct_entries", ("ct_entries",))
def ct_load_arrays(t):
    """Files that hold one JSON array each, of some thousand entries at any number of them."""
    n_files = max(20, -(-t.ct_entries.count() // PER_ARRAY))
    row = F.to_json(F.struct(*t.ct_entries.columns), {"ignoreNullFields": "false"})
    grouped = t.ct_entries.select((F.crc32(F.col("id").cast("string").cast("binary")) % n_files).alias("g"), row.alias("j"))
    arrays = grouped.groupBy("g").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("a"))
    base = scratch(t.spark, "ct")
    write_files(arrays.select(F.concat("g", F.lit(".json")).alias("name"), F.col("a").cast("binary").alias("content")), base)
    return files.load_certificate_log(t.spark, base)


# --- real files, each of some neighbouring documents


def write_files(rows, folder: str) -> None:
    """Write rows (name, content) as files below a shared folder. A task that runs again writes the same files."""
    def write(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.as_buffer())  # not copied
            yield batch.select(["name"])
    rows.select("name", "content").mapInArrow(write, "name string").count()


PER_FILE = 10


def _grouped(t, per: int = PER_FILE):
    """(g, docs): the texts of ``per`` neighbouring ids, in order."""
    one = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.documents.groupBy(F.floor(F.col("doc_id") / per).cast("bigint").alias("g")).agg(
        F.array_sort(F.collect_list(one)).alias("docs"))


def _file_of(build):
    """Arrow column function: content of a file from its group, by ``build(number, [(id, text), ...])``."""
    @F.arrow_udf(T.BinaryType())
    def content(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for g, docs in pieces(batch):
                yield pa.array([build(n, [(d["doc_id"], d["text"]) for d in own])
                                for n, own in zip(g.to_pylist(), docs.to_pylist())], pa.binary())
    return content


def _zip_bytes(members) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return buffer.getvalue()


def _dump_bytes(g: int, docs) -> bytes:
    import gzip

    plain = "".join(f"{text}\n" for _, text in docs).encode()
    if g % 5 < 2:
        return plain
    return gzip.compress(plain) if g % 5 < 4 else _zip_bytes([("in/lines.txt", plain)])


DUMP_NAME = "g || CASE g % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.gz' WHEN 3 THEN '.GZ' ELSE '.zip' END"


@query(
    "scan_dump_files",
    f"SELECT {DUMP_NAME} || CASE g % 5 WHEN 4 THEN '/in/lines.txt' ELSE '' END AS source_file, {D.strip('l')} AS line FROM"
    f" (SELECT doc_id // {PER_FILE} AS g, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE {D.strip('l')} <> ''",
)
def scan_dump_files(t):
    """Text, gzip and zip files with extensions in either case, read from a folder."""
    base = scratch(t.spark, "dump")
    rows = _grouped(t).select(F.expr(DUMP_NAME).alias("name"), _file_of(_dump_bytes)("g", "docs").alias("content"))
    write_files(rows, base)
    source = F.regexp_extract("source_file", r"(\d+\.\w+(/in/.*)?)$", 1)
    return files.scan_dump(t.spark, base).select(source.alias("source_file"), "line")


@query(
    "scan_zip_dump",
    f"SELECT source_file, line FROM (SELECT doc_id // {PER_FILE} || '.zip/in/' || doc_id || '.txt' AS source_file,"
    f" {D.strip('l')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE line <> ''",
)
def scan_zip_dump(t):
    """Archives of several members, read from a folder."""
    base = scratch(t.spark, "zips")
    content = _file_of(lambda g, docs: _zip_bytes([(f"in/{i}.txt", text) for i, text in docs]))
    write_files(_grouped(t).select(F.concat("g", F.lit(".zip")).alias("name"), content("g", "docs").alias("content")), base)
    lines = files.scan_dump(t.spark, base, (".zip",))
    return lines.select(F.regexp_extract("source_file", r"(\d+\.zip/in/.*)$", 1).alias("source_file"), "line")


PER_ARCHIVE = 50


@query(
    "scan_zip_members",
    f"SELECT source_file, line FROM (SELECT doc_id // {PER_ARCHIVE} || '.zip/in/' || doc_id || '.txt' AS source_file,"
    f" {D.strip('l')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE line <> ''",
)
def scan_zip_members(t):
    """Archives of many members, each member read by a task of its own choice."""
    base = scratch(t.spark, "zips")
    content = _file_of(lambda g, docs: _zip_bytes([(f"in/{i}.txt", text) for i, text in docs]))
    archives = _grouped(t, PER_ARCHIVE).select(F.concat("g", F.lit(".zip")).alias("name"), content("g", "docs").alias("content"))
    write_files(archives, base)
    lines = files.scan_dump(t.spark, base, (".zip",), by_member=True)
    return lines.select(F.regexp_extract("source_file", r"(\d+\.zip/in/.*)$", 1).alias("source_file"), "line")


SKIPPED_NAME = "g || CASE g % 5 WHEN 0 THEN '.zip' WHEN 1 THEN '.GZ' WHEN 2 THEN '.gz' WHEN 3 THEN '.ZIP' ELSE '.csv' END"
TEXT_CAP = 20_000


def _damaged_bytes(g: int, docs) -> bytes:
    import gzip

    plain = "".join(f"{text}\n" for _, text in docs).encode()
    if g % 5 in (1, 2):
        packed = gzip.compress(plain)
        return packed if g % 5 == 1 else packed[: len(packed) // 2]
    return _zip_bytes([("in/lines.txt", plain)]) if g % 5 == 0 else plain


@query(
    "skipped_files",
    f"""SELECT {SKIPPED_NAME} AS file, CASE g % 5 WHEN 4 THEN 'extension' ELSE 'unreadable' END AS reason
 FROM (SELECT DISTINCT doc_id // {PER_FILE} AS g FROM documents) WHERE g % 5 IN (2, 3, 4)
 UNION ALL SELECT g || '.txt', 'oversize' FROM (SELECT doc_id // {PER_FILE} AS g, sum(strlen(text) + 1) AS n FROM documents GROUP BY 1)
 WHERE n > {TEXT_CAP}""",
)
def skipped_files(t):
    """Damaged files, files of another kind, and files over a cap that the caller sets."""
    mixed, plain = scratch(t.spark, "mixed"), scratch(t.spark, "plain")
    grouped = _grouped(t)
    write_files(grouped.select(F.expr(SKIPPED_NAME).alias("name"), _file_of(_damaged_bytes)("g", "docs").alias("content")), mixed)
    texts = F.concat(F.array_join(F.transform("docs", lambda d: d["text"]), "\n"), F.lit("\n")).cast("binary")
    write_files(grouped.select(F.concat("g", F.lit(".txt")).alias("name"), texts.alias("content")), plain)
    skipped = files.skipped_files(t.spark, mixed).unionByName(files.skipped_files(t.spark, plain, max_bytes=TEXT_CAP))
    return skipped.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "reason")


_DOCX = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>',
    '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>", "</w:body></w:document>",
)
_XLSX = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>',
    '<row><c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c><c><v>7</v></c><c><v>0</v></c></row>",
    "</sheetData></worksheet>",
)
_CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"'
    ' xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>{}</dc:creator></cp:coreProperties>'
)


@F.arrow_udf(T.BinaryType())
def _office_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    from xml.sax.saxutils import escape

    for batch in batches:
        for text, source, kind in pieces(batch):
            out = []
            for s, author, k in zip(text.to_pylist(), source.to_pylist(), kind.to_pylist()):
                head, left, right, tail = _DOCX if k == "docx" else _XLSX
                body = head + "".join(left + escape(p) + right for p in s.split("\n")) + tail
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml" if k == "docx" else "xl/worksheets/sheet1.xml", body)
                    z.writestr("docProps/core.xml", _CORE.format(escape(author)))
                out.append(buffer.getvalue())
            yield pa.array(out, pa.binary())


KIND = "CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'pptx' END"
OFFICE_TEXT = (
    "CASE doc_id % 3 WHEN 0 THEN text || chr(10) WHEN 1 THEN array_to_string(list_transform(string_split(text, chr(10)),"
    " lambda l: CASE WHEN l = '' THEN '7 ' ELSE l || ' 7 ' END), chr(10)) || chr(10) ELSE '' END"
)


def office(t):
    kind = F.expr(KIND)
    rows = t.documents.select("doc_id", "source", "text", kind.alias("kind")).withColumn(
        "content", _office_of("text", "source", "kind")
    )
    return files.office_scan(rows.drop("text"), ["doc_id"], kind="kind")


@query(
    "office_scan",
    f"SELECT doc_id, {KIND} AS file_type, md5(s) AS digest, CAST(length(s) AS INTEGER) AS text_length,"
    " CASE doc_id % 3 WHEN 0 THEN source ELSE '' END AS author, CASE doc_id % 3 WHEN 1 THEN source ELSE '' END AS creator,"
    f" CASE doc_id % 3 WHEN 2 THEN '' ELSE 'T' END AS title FROM (SELECT *, {OFFICE_TEXT} AS s FROM documents)",
)
def office_scan(t):
    prop = lambda n: X.or_empty(F.element_at("metadata", F.lit(n))).alias(n)
    return office(t).select(
        "doc_id", "file_type", F.md5("text").alias("digest"), "text_length", prop("author"), prop("creator"), prop("title")
    )


@query(
    "office_findings",
    D.scan(f"(SELECT doc_id, {OFFICE_TEXT} AS text FROM documents)", "doc_id", "text", R.DOCUMENT_RULES),
)
def office_findings(t):
    found = S.scan_kinds(office(t), ["doc_id"], "text", R.DOCUMENT_RULES)
    return found.select("doc_id", "kind", "match_count", F.array_join("sample_matches", " | ").alias("samples"))


@query(
    "document_analysis",
    f"""SELECT doc_id, file_type, text_length, target_mentions, coalesce(kinds, '') AS kinds, author FROM
 (SELECT doc_id, {KIND} AS file_type, CAST(length(s) AS INTEGER) AS text_length,
  CAST((length(s) - length(replace(lower(s), 'the', ''))) / 3 AS INTEGER) AS target_mentions,
  CASE doc_id % 3 WHEN 0 THEN source ELSE '' END AS author FROM (SELECT *, {OFFICE_TEXT} AS s FROM documents))
 LEFT JOIN (SELECT doc_id, string_agg(kind || '=' || match_count, ',' ORDER BY kind) AS kinds FROM
  ({D.scan(f"(SELECT doc_id, {OFFICE_TEXT} AS text FROM documents)", "doc_id", "text", R.DOCUMENT_RULES)}) GROUP BY 1) USING (doc_id)""",
)
def document_analysis(t):
    """Office files with their length, findings, mentions of a word and author in one row each."""
    rows = C.document_analysis(office(t), ["doc_id", "file_type"], "text", "the")
    entry = F.transform("sensitive_data", lambda f: F.concat(f["kind"], F.lit("="), f["match_count"].cast("string")))
    author = X.or_empty(F.element_at("metadata", F.lit("author")))
    return rows.select("doc_id", "file_type", "text_length", "target_mentions",
                       F.array_join(F.array_sort(entry), ",").alias("kinds"), author.alias("author"))


_SHEETS = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/>'
    "</Relationships>",
)


def _office_bytes(g: int, docs) -> bytes:
    """A document of all texts, or a workbook that names its second sheet first."""
    from xml.sax.saxutils import escape

    if g % 4 == 3:
        return b"no archive"
    head, left, right, tail = _DOCX if g % 4 == 0 else _XLSX
    body = lambda own: head + "".join(left + escape(p) + right for _, s in own for p in s.split("\n")) + tail
    if g % 4 == 0:
        return _zip_bytes([("word/document.xml", body(docs)), ("docProps/core.xml", _CORE.format(g))])
    first, rest = docs[:4], docs[4:]
    return _zip_bytes([("xl/worksheets/sheet1.xml", body(rest)), ("xl/worksheets/sheet2.xml", body(first)),
                       ("xl/workbook.xml", _SHEETS[0]), ("xl/_rels/workbook.xml.rels", _SHEETS[1])])


OFFICE_NAME = "g || CASE g % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.XLSX' ELSE '.docx' END"
_ROWS = "list_transform(string_split(text, chr(10)), lambda l: CASE WHEN g % 4 = 0 THEN l WHEN l = '' THEN '7 ' ELSE l || ' 7 ' END)"


@query(
    "office_files",
    f"SELECT {OFFICE_NAME} AS file, md5(string_agg(array_to_string({_ROWS}, chr(10)) || chr(10), '' ORDER BY doc_id)) AS digest"
    f" FROM (SELECT *, doc_id // {PER_FILE} AS g FROM documents) WHERE g % 4 <> 3 GROUP BY g",
)
def office_files(t):
    """Documents and workbooks read from a folder; damaged ones give no row."""
    base = scratch(t.spark, "office")
    rows = _grouped(t).select(F.expr(OFFICE_NAME).alias("name"), _file_of(_office_bytes)("g", "docs").alias("content"))
    write_files(rows, base)
    read = files.binary_files(t.spark, base, ".docx").unionByName(files.binary_files(t.spark, base, ".xlsx"))
    return files.office_scan(read).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.md5("text").alias("digest"))


@query(
    "export_findings",
    f"SELECT f AS format, doc_id, kind, match_count FROM ({D.scan('planted', 'doc_id', 'text', R.CODE_RULES)}),"
    " (SELECT unnest(['json', 'csv', 'txt']) AS f)",
    ("planted",),
)
def export_findings(t):
    found = S.scan_kinds(t.planted, ["doc_id"], "text", R.CODE_RULES)
    paths = sinks.export_findings(
        found, scratch(t.spark, "export"), "Acme.example.com", "secrets", "20240101_000000", "json,csv,txt",
        ["doc_id", "kind", "match_count"],
    )
    fields = "doc_id bigint, kind string, match_count int"
    as_json = t.spark.read.schema(fields).json(paths["json"])
    as_csv = t.spark.read.option("header", True).schema(f"{fields}, sample_matches string").csv(paths["csv"])
    parts = F.split("value", " ")
    as_txt = t.spark.read.text(paths["txt"]).select(
        parts[0].cast("bigint").alias("doc_id"), parts[1].alias("kind"), parts[2].cast("int").alias("match_count")
    )
    tagged = [
        df.select(F.lit(name).alias("format"), "doc_id", "kind", "match_count")
        for name, df in (("json", as_json), ("csv", as_csv), ("txt", as_txt))
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("export_report", f"SELECT section, item, url, detail FROM ({REPORT_SQL})", ("urls", "pastes"))
def export_report(t):
    root = sinks.export_report(report(t), scratch(t.spark, "report"), TARGET, "documents", "20240101_000000", "json,csv,txt")
    fields = "item string, url string, detail string, section string"
    return t.spark.read.schema(fields).json(f"{root}/format=json").select(
        "section", "item", X.or_empty("url").alias("url"), "detail"
    )


# --- streaming

MENTION = D.words("title || ' ' || content_preview", X.mention_keywords(TARGET))
IN_CONTENT = D.words("content", X.mention_keywords(TARGET))


def watch(t, pastes, folder: str):
    """Run the monitor over a stream of pastes until all of it is processed; returns what it wrote."""
    W.monitor(pastes, TARGET, "2 days", folder, scratch(t.spark, "offsets")).awaitTermination()
    return t.spark.read.parquet(folder)


def pastes_of(t, documents):
    """The paste table's view of a stream of documents."""
    return t.spark.sql(DERIVED["pastes"][0].format(documents="{documents}"), documents=documents)


def _stream_result(t):
    # A stream reads folders; the glob also fits a table that is one file.
    path = f"{t.sf_dir.rstrip('/')}/documents.parque[t]"
    arriving = t.spark.readStream.schema(t.documents.schema).parquet(path)
    return watch(t, pastes_of(t, arriving), scratch(t.spark, "detections"))


@query(
    "stream_detections",
    f"SELECT DISTINCT md5(url || title || date) AS content_id, url, title, date, 'real_time' AS detection_type FROM pastes"
    f" WHERE {MENTION} AND {IN_CONTENT}",
    ("pastes",),
)
def stream_detections(t):
    return _stream_result(t).select("content_id", "url", "title", "date", "detection_type")


#: One content id for each document, so that its first arrival is one known row.
OWN_URL = "(SELECT * REPLACE (url || '#' || doc_id AS url) FROM pastes)"
DETECTED = f"(SELECT *, md5(url || title || date) AS content_id FROM {OWN_URL} WHERE {MENTION} AND {IN_CONTENT})"
SCORES = ("risk_score", "has_credentials", "has_code", "target_mentions", "samples")


def own_url(pastes):
    return pastes.withColumn("url", F.concat("url", F.lit("#"), "doc_id"))


def _scores(found):
    samples = F.array_join(F.flatten(F.transform("sensitive_data", lambda f: f["sample_matches"])), " | ")
    return found.withColumn("samples", samples).select("content_id", "doc_id", *SCORES)


@query(
    "stream_equals_batch",
    f"SELECT unnest(['batch', 'stream']) AS side, content_id, doc_id, risk_score, has_credentials, has_code, target_mentions"
    f" FROM ({D.scored(DETECTED, 'content_id, doc_id', 'content', TARGET, R.PASTE_RULES)})",
    ("pastes",),
)
def stream_equals_batch(t):
    """Every detection of either side with its score, flags and mentions; samples differ from the other side's in no row."""
    path = f"{t.sf_dir.rstrip('/')}/documents.parque[t]"
    arriving = own_url(pastes_of(t, t.spark.readStream.schema(t.documents.schema).parquet(path)))
    stream = _scores(watch(t, arriving, scratch(t.spark, "detections")))
    batch = _scores(W.detect(own_url(t.pastes), TARGET))
    both = batch.withColumn("side", F.lit("batch")).unionByName(stream.withColumn("side", F.lit("stream")))
    other = {"batch": stream, "stream": batch}
    same = [both.where(F.col("side") == n).join(o.select("content_id", "samples"), ["content_id", "samples"], "left_semi")
            for n, o in other.items()]
    return same[0].unionByName(same[1]).drop("samples")


@query(
    "stream_late_paste",
    "SELECT content_id, doc_id, seen_at - CASE doc_id % 2 WHEN 1 THEN INTERVAL 400 DAYS ELSE INTERVAL 0 DAYS END AS seen_at"
    f" FROM {DETECTED}",
    ("pastes",),
)
def stream_late_paste(t):
    """Pastes seen long ago come in last, then the first ones again: none is lost, none is reported twice."""
    folder, offsets, sink = (scratch(t.spark, name) for name in ("arriving", "offsets", "detections"))
    pastes = own_url(t.pastes)
    recent = pastes.where("doc_id % 2 = 0")
    old = pastes.where("doc_id % 2 = 1").withColumn("seen_at", F.col("seen_at") - F.expr("INTERVAL 400 DAYS"))
    for part in (recent, old, recent):
        part.write.mode("append").parquet(folder)
        arriving = t.spark.readStream.schema(pastes.schema).parquet(folder)
        W.monitor(arriving, TARGET, "2 days", sink, offsets).awaitTermination()
    return t.spark.read.parquet(sink).select("content_id", "doc_id", "seen_at")


@query(
    "stream_seen_history",
    f"SELECT content_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'batch' ELSE 'real_time' END AS detection_type FROM {DETECTED}",
    ("pastes",),
)
def stream_seen_history(t):
    """Batch run, stream over all pastes with that history, restart, all pastes again beyond the delay: each is reported once."""
    folder, offsets, sink, history = (scratch(t.spark, name) for name in ("arriving", "offsets", "detections", "history"))
    pastes = own_url(t.pastes)
    W.detect(pastes.where("doc_id % 3 = 0"), TARGET).select("content_id", "doc_id").write.parquet(history)
    seen = t.spark.read.parquet(history)
    for part in (pastes.where("doc_id % 3 <> 2"), pastes, pastes.where("doc_id % 3 <> 1")):
        part.write.mode("append").parquet(folder)
        arriving = t.spark.readStream.schema(pastes.schema).parquet(folder)
        W.monitor(arriving, TARGET, "0 seconds", sink, offsets, seen=seen).awaitTermination()
    stream = t.spark.read.parquet(sink).select("content_id", "doc_id", "detection_type")
    return seen.withColumn("detection_type", F.lit("batch")).unionByName(stream)


@query(
    "stream_summary",
    f"""SELECT site, count(*) AS total_pastes_found, count(*) FILTER (has_credentials) AS credential_leaks,
 count(*) FILTER (NOT has_credentials AND has_code) AS code_exposures, count(*) FILTER (risk_score >= 8) AS high_risk_pastes,
 count(*) FILTER (risk_score BETWEEN 5 AND 7) AS medium_risk_pastes, count(*) FILTER (risk_score < 5) AS low_risk_pastes,
 max(seen_at) AS last_checked FROM ({D.scored(DETECTED, 'site, content_id, seen_at', 'content', TARGET, R.PASTE_RULES)}) GROUP BY site""",
    ("pastes",),
)
def stream_summary(t):
    """Detections of three batches of pastes, with repeats; the counts kept on the way are those of one pass over all."""
    folder, offsets, sink, counts, done = (
        scratch(t.spark, name) for name in ("arriving", "offsets", "detections", "counts", "counted"))
    pastes = own_url(t.pastes)
    for part in (pastes.where("doc_id % 3 = 0"), pastes.where("doc_id % 3 <> 2"), pastes):
        part.write.mode("append").parquet(folder)
        arriving = t.spark.readStream.schema(pastes.schema).parquet(folder)
        W.monitor(arriving, TARGET, "0 seconds", sink, offsets, forever=True).awaitTermination()
        found = t.spark.readStream.schema(t.spark.read.parquet(sink).schema).parquet(sink)
        W.summarise(found, counts, done, "seen_at").awaitTermination()
    return W.summary(t.spark, counts)


REDACTED_KINDS = [r for r in R.PASTE_RULES if r.shown != "clear"]


def _redacted_sql(c: str) -> str:
    for r in REDACTED_KINDS:
        c = f"regexp_replace({c}, {D.q(r.pattern)}, '***REDACTED***', 'g')"
    return c


@query(
    "detections_batch",
    f"SELECT doc_id, site, CASE WHEN length(r) > 500 THEN substr(r, 1, 500) || '...' ELSE r END AS content_preview"
    f" FROM (SELECT doc_id, site, {_redacted_sql('content')} AS r FROM pastes WHERE {MENTION} AND {IN_CONTENT})",
    ("pastes",),
)
def detections_batch(t):
    return W.detect(t.pastes, TARGET).select("doc_id", "site", "content_preview")
