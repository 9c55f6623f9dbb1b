"""Every query against its oracle on the smallest tables, in one pass."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as contract
from broadsheet.operators import convert
from broadsheet.plans import queries_documents
from broadsheet.plans.inputs import sheet_blocks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in found.fetchall())
    actual = sorted(tuple(plain(row[c]) for c in sorted(columns)) for row in df.collect())
    assert actual == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_pages_markdown_holds_every_page_and_line(spark):
    blocks = {}
    for r in sheet_blocks(spark, SF).select("doc_id", "page_no", "seq", "label", "text").collect():
        blocks.setdefault((r.doc_id, r.page_no), []).append(r)
    made = {(r.doc_id, r.page_no): r.page_markdown for r in QUERIES["page_markdown_all"](spark, SF).collect()}
    assert set(made) == set(blocks) and {p % 2 for _, p in made} == {0, 1}
    for page, rows in blocks.items():
        first = min((r.seq for r in rows if r.label == "title"), default=-1)
        assert made[page].count("\n## ") >= sum(r.label == "title" and r.text.strip() != "" for r in rows)
        assert all(r.text.strip() in made[page] for r in rows if r.seq >= first and (first == -1 or r.label != "header"))
    titles = sum(r.label == "title" for rows in blocks.values() for r in rows)
    assert sum(r.total_articles for r in QUERIES["segment_document_all"](spark, SF).collect()) == titles


def test_whole_articles_and_pages_without_a_title(spark):
    rows = [(1, 1, 1, "header", "head"), (1, 1, 2, "text", "only"), (1, 2, 1, "text", "before"), (1, 2, 2, "title", "A"), (1, 2, 3, "text", "one"),
            (1, 2, 4, "header", "head"), (1, 2, 5, "text", "two"), (1, 2, 6, "title", "B")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, label string, text string")
    made = {r.page_no: r.page_markdown for r in convert.page_markdown(convert.page_text(blocks), queries_documents.whole_articles(blocks)).collect()}
    assert made == {1: "# Page 1\n\nhead\nonly", 2: "# Page 2\n\n## A\n\none\ntwo\n\n## B"}
