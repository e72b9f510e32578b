"""Readers, writers and the stream on files the tests write."""

import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from seepage.sources import files, sinks
from seepage.streaming import monitor as W


def test_scan_dump(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b" one \r\n\n\tt\xfftwo\n")
    (tmp_path / "sub" / "b.gz").write_bytes(gzip.compress(b"three\n  \nfour"))
    (tmp_path / "skip.csv").write_text("five")
    (tmp_path / "big.txt").write_text("x" * 5000)
    with zipfile.ZipFile(tmp_path / "c.ZIP", "w") as z:
        z.writestr("in/d.txt", "six\r\n\nse\xfeven".encode("latin-1"))
        z.writestr("large.txt", "y" * 10)
        z.mkdir("dir")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = files.scan_dump(spark, str(tmp_path), max_bytes=4000, spread=3)
    assert got.rdd.getNumPartitions() == 3
    lines = sorted((r.source_file.rsplit("/", 1)[-1], r.line) for r in got.collect())
    assert lines == [("a.TXT", "one"), ("a.TXT", "ttwo"), ("b.gz", "four"), ("b.gz", "three"), ("d.txt", "seven"), ("d.txt", "six"),
                     ("large.txt", "y" * 10)]
    assert any(r.source_file.endswith("c.ZIP/in/d.txt") for r in got.collect())
    with_csv = files.scan_dump(spark, str(tmp_path), (".CSV",))
    assert [r.line for r in with_csv.collect()] == ["five"]
    capped = files.zip_lines(files.binary_files(spark, str(tmp_path), ".zip", 4000), max_member_bytes=9)
    assert sorted(r.line for r in capped.collect()) == []


def test_zip_member_cap_keeps_smaller_ones(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a", "123456789")
        z.writestr("b", "1234567890")
    got = files.zip_lines(files.binary_files(spark, str(tmp_path), ".zip", 4000), max_member_bytes=9)
    assert [r.line for r in got.collect()] == ["123456789"]


def test_many_lines_leave_a_member_in_batches(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "\n".join(str(i) for i in range(25_000)))
    got = files.zip_lines(files.binary_files(spark, str(tmp_path), ".zip", 10**6))
    assert got.agg(F.count_distinct("line")).first()[0] == 25_000


def test_wordlist_and_certificate_log(spark, tmp_path):
    (tmp_path / "w").write_text(" a \n\nb\n")
    assert sorted(r.word for r in files.load_wordlist(spark, str(tmp_path / "w")).collect()) == ["a", "b"]
    (tmp_path / "ct.json").write_text(json.dumps([{"id": 1, "name_value": "a\nb", "extra": 2}, {"id": 2}], indent=1))
    got = files.load_certificate_log(spark, str(tmp_path / "ct.json")).orderBy("id").collect()
    assert [(r.id, r.name_value) for r in got] == [(1, "a\nb"), (2, None)]


def office_file(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buffer.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    core = ('<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"'
            ' xmlns:d="http://purl.org/dc/elements/1.1/"><d:creator>Ann</d:creator></c:coreProperties>')
    (tmp_path / "a.docx").write_bytes(office_file({
        "word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"
                             f"<w:tbl><w:p><w:r><w:t>in table</w:t></w:r></w:p></w:tbl><w:p/></w:body></w:document>",
        "docProps/core.xml": core}))
    (tmp_path / "b.XLSX").write_bytes(office_file({
        "xl/sharedStrings.xml": f"<sst {s}><si><t>sh</t></si></sst>",
        "xl/worksheets/sheet2.xml": f"<worksheet {s}><sheetData><row><c><v>5</v></c></row></sheetData></worksheet>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c t="b"><v>0</v></c><c><f>A1</f><v>3</v></c></row>'
                                    "<row><c/></row></sheetData></worksheet>"}))
    (tmp_path / "c.pptx").write_bytes(b"anything")
    (tmp_path / "d.docx").write_bytes(b"broken")
    found = [files.binary_files(spark, str(tmp_path), e, 10**6) for e in (".docx", ".xlsx", ".pptx")]
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.office_scan(found[0].union(found[1]).union(found[2])).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.docx": "x\ty\n\n", "b.XLSX": "sh =A1 \n\n5 \n", "c.pptx": ""}
    assert got["a.docx"].metadata["author"] == "Ann" and got["b.XLSX"].metadata["creator"] == ""
    assert got["a.docx"].text_length == 5


def test_sinks(spark, tmp_path):
    rows = [(2, ["a", "b"], {"z": 1, "b": "é"}), (1, [], None)]
    df = spark.createDataFrame(rows, "z int, list array<string>, nested struct<z:int,b:string>")
    paths = sinks.export_findings(df, str(tmp_path), "https://Ex.com/x", "kind", "t0", "json+csv+txt", ["z", "list"])
    assert set(paths) == {"json", "csv", "txt"} and "target=ex_com/kind=kind/run_ts=t0" in paths["csv"]
    lines = sorted(r.value for r in spark.read.text(paths["json"]).collect())
    assert lines == ['{"list":["a","b"],"nested":{"b":"é","z":1},"z":2}', '{"list":[],"z":1}']
    csv = spark.read.option("header", True).option("escape", '"').csv(paths["csv"]).orderBy("z").collect()
    assert csv[1].list == "a, b" and json.loads(csv[1].nested) == {"z": 1, "b": "é"}
    assert sinks.export_findings(df, str(tmp_path), "ex.com", "kind", "t1", "none") == {}


def test_report_sections(spark, tmp_path):
    report = spark.createDataFrame([("s1", "i", "u", "d"), ("s2", "j", None, "e")], "section string, item string, url string, detail string")
    root = sinks.export_report(report, str(tmp_path), "ex.com", "m", "t0", "json,csv,txt")
    for fmt in ("json", "csv", "txt"):
        assert spark.read.text(f"{root}/format={fmt}").select("section").distinct().count() == 2


def test_stamped(spark):
    row = sinks.stamped(spark.range(1), source="s", search_pattern="p").first()
    assert (row.source, row.search_pattern) == ("s", "p") and row.discovered_at is not None


PASTE = "site string, title string, url string, author string, date string, content_preview string, content string, seen_at timestamp"


def test_stream_reports_each_id_once_over_batches(spark, tmp_path):
    def paste(site, n, content, hour):
        return {"site": site, "title": f"acme {n}", "url": f"u{n}", "author": "", "date": "", "content_preview": "",
                "content": content, "seen_at": f"2024-01-01T{hour:02}:00:00"}

    batches = [
        [paste("a", 1, "acme pass" + "word=x", 1), paste("b", 1, "acme", 1), paste("a", 2, "nothing", 1)] + [paste("a", 3, "acme", 1)] * 50,
        [paste("c", 1, "acme", 2), paste("a", 4, "ACME.example.com", 2)],
        [{**paste("a", 5, "acme", 3), "title": "other"}],
        [{**paste("d", 6, "acme", 1), "seen_at": "2023-01-01T00:00:00"}],  # seen long ago, comes in last
    ]
    (tmp_path / "in").mkdir()
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, batch in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        arriving = spark.readStream.schema(PASTE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        W.monitor(arriving, "acme.example.com", "1 day", sink, state).awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted(r.url for r in got.collect()) == ["u1", "u3", "u4", "u6"]
    assert "content" not in got.columns and got.where("detection_type = 'real_time'").count() == 4
    batch = W.detect(spark.read.schema(PASTE).json(str(tmp_path / "in")), "acme.example.com")
    assert {r.content_id for r in batch.collect()} == {r.content_id for r in got.collect()}
    assert not any("word=x" in r.content_preview for r in got.collect())
