"""Operations over documents and collections."""

import json

import pytest
from test_cluster import TWO_PAPERS, page

from broadsheet.operators import documents


def test_segmented_pages_hold_articles_and_text(spark):
    row, = documents.segmented_pages(page(spark, TWO_PAPERS)).collect()
    assert [a.title for a in row.articles] == ["알림", "오른쪽 기사 제목"] and row.unassigned == []
    assert row.page_text.startswith("한겨레\n한국일보")


def test_batch_runs_each_operation_and_keeps_failures_as_rows(spark):
    blocks = page(spark, TWO_PAPERS)
    lists = spark.createDataFrame([(1, [1, 99]), (2, [1]), (3, [])], "collection_id int, file_ids array<long>")
    rows, runs = documents.run_batch(lists, blocks, "extract_structured_data", [{"name": "title", "label": "title", "type": "string", "required": False}])
    found = {(r.collection_id, r.file_id): r for r in rows.collect()}
    assert json.loads(found[1, 1].result) == json.loads(found[2, 1].result) == {"title": "알림"}
    assert (found[1, 99].status, found[1, 99].error) == ("failed", "file not found: 99")
    assert {(r.collection_id, r.success_count, r.failure_count, r.status) for r in runs.collect()} == {(1, 1, 1, "completed_with_errors"), (2, 1, 0, "completed")}
    converted = documents.run_batch(lists, blocks, "convert_document", formats="markdown")[0].where("collection_id = 2").first()
    assert "## 오른쪽 기사 제목" in json.loads(converted.result)["markdown"]
    with pytest.raises(ValueError):
        documents.run_batch(lists, blocks, "print")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_shuffled_once_for_articles_and_text(spark):
    """The text and the Markdown of a page come from the row that its articles come from."""
    blocks = page(spark, TWO_PAPERS)
    pages = plan_of(documents.segmented_pages(blocks))
    assert "Join" not in pages and pages.count("RepartitionByExpression") == 1
    markdown = plan_of(documents.convert_documents(blocks, "markdown"))
    assert "Join" not in markdown and markdown.count("RepartitionByExpression") == 1


def test_place_titles_makes_each_page_once(spark):
    from broadsheet.plans.queries_layout import q_place_titles

    plan = plan_of(q_place_titles(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("collect_list") == 1
