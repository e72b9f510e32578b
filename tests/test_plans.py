"""Properties of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.operators import pages as G
from seepage.operators import scan as S
from seepage.operators import score as C
from seepage.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_and_no_shuffle_for_all_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(S.scan_kinds(docs, ["doc_id"], "text", R.DOCUMENT_RULES))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Python" not in text
    assert text.count("regexp_extract_all(text") == len(R.DOCUMENT_RULES)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_a_filter_on_the_score_does_not_search_twice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    text = plan(C.score_content(docs, "text", "acme.com").where("risk_score >= 8").where("source = 'src1'"))
    assert text.count("regexp_extract_all(text") == len(R.PASTE_RULES)
    assert "EqualTo(source,src1)" in text


def test_a_page_is_parsed_once(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    facts = G.page_flags(G.with_nodes(pages), ["page_id", "url"])
    text = plan(facts.where(F.contains("title", F.lit("x"))).where(F.contains("url", F.lit("example.com"))))
    assert text.count("_parse(") == 1
    assert "StringContains(url,example.com)" in text


@pytest.mark.parametrize("name", ["first_per_host", "dedupe_key", "dedupe_content_id", "first_per_email", "new_only", "exposure_summary"])
def test_keep_first_neither_sorts_nor_moves_texts(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SortAggregate" not in text and "min_by" not in text
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("content" in line or "html" in line for line in moved)


@pytest.mark.parametrize("name, table", [("ct_stats", "orders"), ("dump_stats", "orders")])
def test_statistics_read_their_source_once(spark, name, table):
    text = plan(QUERIES[name](spark, SF))
    assert text.count(f"{table}.parquet") == 1 and text.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    if name == "reachable_pages" or name.startswith(("export", "scan_text", "stream_")):
        pytest.skip("runs jobs while it is built")
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
