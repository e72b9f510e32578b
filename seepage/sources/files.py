"""Readers for dump directories, word lists, certificate-log exports and office files."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage import rules as R
from seepage.functions.pieces import PIECE, pieces
from seepage.functions.text import strip
from seepage.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = "source_file string, line string"
CT_ENTRY = (
    "id bigint, entry_timestamp string, not_before string, not_after string, common_name string,"
    " issuer_name string, serial_number string, name_value string"
)
_LINE_BATCH = 10_000
#: Packed bytes of archive members that one task unpacks.
MEMBER_TASK_BYTES = 64 << 20


def _any_case(extension: str) -> str:
    """Glob for file names with the extension in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _clean_lines(df: DataFrame) -> DataFrame:
    """Stripped lines that are not blank. Bytes that are no UTF-8 are left out."""
    repaired = F.replace(F.make_valid_utf8("line"), F.lit("\ufffd"), F.lit(""))
    line = F.when(F.is_valid_utf8("line"), F.col("line")).otherwise(repaired)
    return df.withColumn("line", strip(line)).where("line != ''")


def _within(df: DataFrame, size, max_bytes: int | None) -> DataFrame:
    return df if max_bytes is None else df.where(size <= max_bytes)


def scan_text_dump(spark: SparkSession, path: str, extensions=(".txt", ".gz"),
                   max_bytes: int | None = None) -> DataFrame:
    """Lines of all text and gzip files below a directory, by extensions in any case.

    With ``max_bytes`` larger files are left out; ``skipped_files`` lists them.
    """
    # Spark unpacks by the lower-case extension only; the others are unpacked here.
    glob = "{" + ",".join("*.gz" if e.lower() == ".gz" else _any_case(e) for e in extensions) + "}"
    lines = _within(
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path),
        F.col("_metadata.file_size"), max_bytes,
    ).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))
    if any(e.lower() == ".gz" for e in extensions):
        packed = binary_files(spark, path, ".gz", max_bytes).where(~F.endswith("path", F.lit(".gz")))
        lines = lines.unionByName(gzip_lines(packed))
    return _clean_lines(lines)


def binary_files(spark: SparkSession, path: str, extension: str, max_bytes: int | None = None) -> DataFrame:
    """Files (path, length, content) with the extension in any case; those over ``max_bytes`` are never opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case(extension)).load(path)
    )
    return _within(files, F.col("length"), max_bytes).select("path", "length", "content")


def _line_batches(source_lines):
    names, lines, size = [], [], 0
    for name, line in source_lines:
        names.append(name)
        lines.append(line)
        size += len(name) + len(line)
        if len(lines) >= _LINE_BATCH or size >= PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], names=["source_file", "line"])
            names, lines, size = [], [], 0
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], names=["source_file", "line"])


def _gzip_members(path, content, problem):
    """Lines of a gzip file; what cannot be read goes to ``problem``."""
    import gzip
    import io
    import zlib

    try:
        with gzip.open(io.BytesIO(content)) as file:
            for raw in file:
                yield path, raw.decode("utf-8", errors="ignore")
    except (OSError, EOFError, zlib.error):
        problem(path, "unreadable")


def _zip_members(path, content, problem, max_member_bytes=None):
    """Lines of a zip archive's members, as source ``archive/member``."""
    import io
    import zipfile
    import zlib

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                name = f"{path}/{info.filename}"
                if info.is_dir():
                    continue
                if max_member_bytes is not None and info.file_size > max_member_bytes:
                    problem(name, "oversize")
                    continue
                try:
                    with archive.open(info) as member:
                        for raw in member:
                            yield name, raw.decode("utf-8", errors="ignore")
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, zlib.error):
                    problem(name, "unreadable")
    except zipfile.BadZipFile:
        problem(path, "unreadable")


def _unpacked(files: DataFrame, members, on_error: str) -> DataFrame:
    def problem(name, reason):
        if on_error == "raise":
            raise ValueError(f"{name}: {reason}")

    def lines(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from _line_batches(members(path.as_py(), content.as_py(), problem))
    return _clean_lines(files.select("path", "content").mapInArrow(lines, LINES))


def gzip_lines(files: DataFrame, on_error: str = "skip") -> DataFrame:
    """Lines of gzip files (path, content). What cannot be read is skipped, and in ``skipped_files``, or raised."""
    return _unpacked(files, _gzip_members, on_error)


def zip_lines(archives: DataFrame, max_member_bytes: int | None = None, on_error: str = "skip") -> DataFrame:
    """Lines of the members of zip archives (path, content), as source ``archive/member``.

    Lines are handed on in small batches, so a task never holds a whole
    member. Members over ``max_member_bytes``, if given, and unreadable ones
    are skipped, and in ``skipped_files``, unless ``on_error`` is 'raise'.
    """
    def members(path, content, problem):
        return _zip_members(path, content, problem, max_member_bytes)
    return _unpacked(archives, members, on_error)


def _opened(path: str):
    """A seekable file of a path as Spark names it, on a mounted file system or one that Arrow knows."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return open(unquote(urlparse(path).path) if scheme else path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def zip_entries(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, entry, member, packed, size, problem) of every member of the zip archives below a directory, from their central directories.

    No archive is read beyond its directory of members. ``entry`` is a member's
    place there; an archive that has none gives one row with a ``problem``.
    """
    def listed(batches):
        import zipfile

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with _opened(path) as file, zipfile.ZipFile(file) as archive:
                        rows += [(path, i, m.filename, m.compress_size, m.file_size, None)
                                 for i, m in enumerate(archive.infolist()) if not m.is_dir()]
                except zipfile.BadZipFile:
                    rows.append((path, None, None, 0, 0, "unreadable"))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    schema = pa.schema([("path", pa.string()), ("entry", pa.int64()), ("member", pa.string()), ("packed", pa.int64()),
                        ("size", pa.int64()), ("problem", pa.string())])
    archives = binary_files(spark, path, ".zip", max_bytes).select("path")
    return archives.mapInArrow(listed, "path string, entry long, member string, packed long, size long, problem string")


def zip_member_lines(spark: SparkSession, path: str, max_bytes: int | None = None, max_member_bytes: int | None = None,
                     on_error: str = "skip", tasks: int | None = None) -> DataFrame:
    """Lines of the members of all zip archives below a directory, as ``zip_lines`` gives them, each member by a task of its own choice.

    The members of the archives' central directories are dealt out to tasks,
    which seek to each member and unpack it as a stream, so an archive of many
    members is read by many tasks and never held. There are ``tasks`` of them, or
    one for each 64 MB of packed members and one a slot at least. The archives lie on a mounted file
    system or one that Arrow knows; ``zip_lines`` reads those that only Spark does.
    """
    entries = settle(zip_entries(spark, path, max_bytes), "members")
    if on_error == "raise" and (bad := entries.where("problem IS NOT NULL").first()):
        raise ValueError(f"{bad.path}: {bad.problem}")
    chosen = entries.where("problem IS NULL")
    if max_member_bytes is not None:
        over = F.col("size") > max_member_bytes
        if on_error == "raise" and (bad := chosen.where(over).first()):
            raise ValueError(f"{bad.path}/{bad.member}: oversize")
        chosen = chosen.where(~over)
    if tasks is None:
        packed = chosen.agg(F.sum("packed")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-packed // MEMBER_TASK_BYTES))

    def lines(batches):
        import zipfile
        import zlib

        def of(path, entries):
            with _opened(path) as file, zipfile.ZipFile(file) as archive:
                members = archive.infolist()
                for entry in entries:
                    name = f"{path}/{members[entry].filename}"
                    try:
                        with archive.open(members[entry]) as member:
                            for raw in member:
                                yield name, raw.decode("utf-8", errors="ignore")
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, zlib.error):
                        if on_error == "raise":
                            raise ValueError(f"{name}: unreadable") from None

        for batch in batches:  # a task's members are in the order of their archives, so each is opened once a batch
            for path, rows in groupby(zip(batch.column("path").to_pylist(), batch.column("entry").to_pylist()), lambda r: r[0]):
                yield from _line_batches(of(path, [entry for _, entry in rows]))
    dealt = chosen.select("path", "entry").repartition(tasks).sortWithinPartitions("path", "entry")
    return _clean_lines(dealt.mapInArrow(lines, LINES))


def skipped_files(spark: SparkSession, path: str, extensions=R.DUMP_EXTENSIONS, max_bytes: int | None = None,
                  max_member_bytes: int | None = None) -> DataFrame:
    """(path, length, reason) of every file and archive member below a directory that ``scan_dump`` gives no lines of.

    Reasons: 'extension', 'oversize' (over the caps, if given) and 'unreadable'
    (a damaged gzip file, archive or member; its lines up to the damage are given).
    """
    known = [e.lower() for e in extensions]
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    listed = reduce(lambda a, b: a | b, [F.endswith(F.lower("path"), F.lit(e)) for e in known], F.lit(False))
    over = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = F.when(~listed, "extension").when(over, "oversize")
    rows = [all_files.withColumn("reason", reason).where("reason IS NOT NULL")]

    def problems(members):
        def run(batches):
            for batch in batches:
                found = []
                for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    own, content = [], content.as_py()  # one file at a time
                    for _ in members(file, content, lambda name, why: own.append((name, why))):  # noqa: B023
                        pass
                    found += [(name, len(content), why) for name, why in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                    names=["path", "length", "reason"])
        return run

    def zipped(file, content, problem):
        return _zip_members(file, content, problem, max_member_bytes)
    for extension, members in ((".gz", _gzip_members), (".zip", zipped)):
        if extension in known:
            packed = binary_files(spark, path, extension, max_bytes).select("path", "content")
            rows.append(packed.mapInArrow(problems(members), "path string, length long, reason string"))
    return reduce(DataFrame.unionByName, rows)


def scan_dump(spark: SparkSession, path: str, extensions=R.DUMP_EXTENSIONS, max_bytes: int | None = None,
              spread: int | None = None, max_member_bytes: int | None = None, by_member: bool = False) -> DataFrame:
    """Lines of all dump files below a directory: text, gzip and zip, by the listed extensions in any case.

    Without caps every file is read; what is skipped is in ``skipped_files``. A
    gzip or zip file is read by one task; ``spread`` deals its lines out to
    that many tasks before they are searched. With ``by_member`` zip archives
    are read by ``zip_member_lines``, each by as many tasks as its members take.
    """
    plain = tuple(e for e in extensions if e.lower() != ".zip")
    frames = [scan_text_dump(spark, path, plain, max_bytes)] if plain else []
    if len(plain) < len(extensions):
        frames.append(zip_member_lines(spark, path, max_bytes, max_member_bytes) if by_member
                      else zip_lines(binary_files(spark, path, ".zip", max_bytes), max_member_bytes))
    lines = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return lines.repartition(spread) if spread else lines


def load_wordlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip("value").alias("word")).where("word != ''")


def load_certificate_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Exported log entries; one JSON array per file, or one entry per line with ``multi_line=False``."""
    return spark.read.schema(CT_ENTRY).json(path, multiLine=multi_line)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PROPERTIES = {"title": "title", "creator": "creator", "created": "created", "modified": "modified",
               "subject": "subject", "keywords": "keywords"}


def _properties(archive, xml, author: str) -> dict:
    found = dict.fromkeys(_PROPERTIES, "")
    if "docProps/core.xml" in archive.namelist():
        for el in xml.fromstring(archive.read("docProps/core.xml")):
            name = el.tag.rpartition("}")[2]
            if name in found:
                found[name] = el.text or ""
    found[author] = found.pop("creator")
    return found


def _docx_text(archive, xml) -> str:
    body = xml.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    lines = []
    for paragraph in body.findall(f"{_W}p"):
        lines.append("".join((el.text or "") if el.tag == f"{_W}t" else marks.get(el.tag, "")
                             for el in paragraph.iter()))
    return "".join(line + "\n" for line in lines)


def _sheets(archive, xml) -> list[str]:
    """Sheet files in the order of the workbook; by number if it names none."""
    names = archive.namelist()
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        targets = {el.get("Id"): el.get("Target") for el in xml.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        ids = [el.get(_R_ID) for el in xml.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        own = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in (targets.get(i, "") for i in ids) if t]
        own = [n for n in own if n in names]
        if own:
            return own
    return sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))


def _xlsx_text(archive, xml) -> str:
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in xml.fromstring(archive.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))

    def value(cell):
        kind, v = cell.get("t"), cell.findtext(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
        formula = cell.findtext(f"{_S}f")
        if formula:
            return "=" + formula
        if v is None:
            return ""
        if kind == "s":
            return shared[int(v)]
        if kind == "b":
            return "True" if v == "1" else ""
        return "" if kind in (None, "n") and float(v) == 0 else v

    out = []
    for sheet in _sheets(archive, xml):
        for row in xml.fromstring(archive.read(sheet)).iter(f"{_S}row"):
            out.append("".join(f"{v} " for v in map(value, row.iter(f"{_S}c")) if v) + "\n")
    return "".join(out)


def _read_office(content, kind):
    import io
    import xml.etree.ElementTree as xml
    import zipfile

    if kind == "xls":
        return None
    if content is None or kind not in ("docx", "xlsx"):
        return {"text": "", "metadata": []}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            text = _docx_text(archive, xml) if kind == "docx" else _xlsx_text(archive, xml)
            return {"text": text, "metadata": list(_properties(
                archive, xml, "author" if kind == "docx" else "creator").items())}
    except (zipfile.BadZipFile, xml.ParseError, KeyError, ValueError, IndexError, AttributeError):
        return None


_OFFICE = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
    )
)


@F.arrow_udf(_OFFICE)
def _office(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    item = pa.struct([("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
    for batch in batches:
        for content, kind in pieces(batch):
            rows = (_read_office(c.as_py(), k.as_py()) for c, k in zip(content, kind))
            yield pa.array([[] if r is None else [r] for r in rows], pa.list_(item))


def office_scan(files: DataFrame, keys=("path",), kind: str | None = None) -> DataFrame:
    """Text and core properties of office files.

    docx gives its paragraphs, xlsx the cells of all sheets in the order of the
    workbook; other kinds give empty text. xls and a file that cannot be read
    give no row.
    """
    extension = F.col(kind) if kind else F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return (
        files.withColumn("file_type", extension)
        .select(*keys, "file_type", F.explode(_office("content", "file_type")).alias("o"))
        .select(*keys, "file_type", "o.text", "o.metadata", F.length("o.text").alias("text_length"))
    )
