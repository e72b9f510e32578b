"""Row places, rule tables of any number and archives read by member, against plain Python."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from seepage.operators import scan as S
from seepage.operators.order import placed
from seepage.sources import files


def test_places_follow_the_order_and_split_a_hot_key(spark):
    data = [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 40:02}", i % 7, f"p{i}") for i in range(900)]
    df = spark.createDataFrame(data, "k string, o int, _row string").repartition(5)
    out = placed(df, F.desc_nulls_last("k"), "o", "_row")
    assert out.columns == ["k", "o", "_row", "place"]
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[3])
    assert [r[3] for r in got] == list(range(1, 901))
    order = sorted(data, key=lambda r: (r[1], r[2]))
    want = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    assert [r[:3] for r in got] == want


def test_places_of_equal_rows_and_of_no_rows(spark):
    same = placed(spark.range(500).select(F.lit("x").alias("v"), F.lit(9).alias("place")), "v")
    assert sorted(r.place for r in same.collect()) == list(range(1, 501))
    assert placed(spark.range(0), "id").collect() == []


def test_places_need_no_window_over_the_rows(spark):
    text = placed(spark.range(1000), F.desc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.index("Window") > text.index("BroadcastExchange")


def test_two_thousand_rules(spark):
    texts = [f"Key{i:04}=v{i} key{i * 3 % 2000:04}=x" for i in range(300)] + [None, "", "KEY0001", "token 77 and token 78"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    rules = [(f"r{i}", rf"(?i)key{i:04}=\w+", f"KEY{i:04}") for i in range(2000)]
    rules += [("bare", r"token \d+", None), ("bare", r"token \d+", ""), ("never", "zzz", None), (None, "x", None), ("r", None, "x")]
    table = spark.createDataFrame(rules, "kind string, pattern string, hint string")
    got = {(r.id, r.kind, r.match_count) for r in S.scan_rule_table(docs, ["id"], "body", table).collect()}
    want = {(i, kind, len(found)) for i, text in enumerate(texts) if text for kind, pattern, _ in set(rules) if kind and pattern
            if (found := re.findall(pattern, text))}
    assert got == want and (303, "bare", 2) in got


def test_a_rule_that_does_not_compile_fails_at_once(spark):
    docs = spark.createDataFrame([(1, "x")], "id int, body string")
    table = spark.createDataFrame([("bad", "(x", "x")], "kind string, pattern string, hint string")
    with pytest.raises(ValueError):
        S.scan_rule_table(docs, ["id"], "body", table)
    none = table.where("kind = 'none'")
    assert S.scan_rule_table(docs, ["id"], "body", none).collect() == []


@pytest.fixture
def archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "one archive.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"in/{i}.txt", f" line {i} \n\nsecond\xff {i}".encode("latin-1"))
        z.mkdir("dir")
        z.writestr("large.txt", "y" * 5000)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "torn.zip", "w") as z:
        z.writestr("good.txt", "good")
        z.writestr("bad.txt", "bad bad bad")
    torn = tmp_path / "torn.zip"
    torn.write_bytes(torn.read_bytes().replace(b"bad bad bad", b"bad bXd bad"))
    return str(tmp_path)


def test_one_archive_is_read_by_more_than_one_task(spark, archives):
    own = files.zip_member_lines(spark, archives, tasks=4).withColumn("task", F.spark_partition_id())
    assert own.where("source_file LIKE '%one archive.ZIP/%'").select("task").distinct().count() > 1


def test_members_give_the_lines_of_whole_archives(spark, archives):
    whole = files.scan_dump(spark, archives, (".zip",), max_member_bytes=4000)
    by_member = files.scan_dump(spark, archives, (".zip",), max_member_bytes=4000, by_member=True)
    lines = lambda df: sorted((r.source_file.replace("%20", " "), r.line) for r in df.collect())
    assert lines(by_member) == lines(whole) and len(lines(whole)) > 100
    assert files.zip_member_lines(spark, archives).where("source_file LIKE '%large.txt'").count() == 1


def test_what_cannot_be_read_is_raised_if_asked(spark, archives):
    with pytest.raises(ValueError):
        files.zip_member_lines(spark, archives, on_error="raise")
    entries = files.zip_entries(spark, archives)
    assert entries.where("problem = 'unreadable'").count() == 1 and entries.where("member LIKE 'in/%'").count() == 50
