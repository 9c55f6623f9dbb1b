"""Golden page for the column-wise segmentation."""

import json

from pyspark.sql import functions as F

from broadsheet.operators import segment
from broadsheet.sources import payloads

BLOCKS = [
    ("headline-left-1", "headline", [60, 40, 430, 100], "COUNCIL MEETS AGAIN"),
    ("left-1", "paragraph", [60, 112, 430, 192], "The council returned to its talks after a long night of meetings about money."),
    ("left-2", "paragraph", [60, 204, 430, 292], "Members say that transit and housing and schools remain the largest open items today."),
    ("headline-right-1", "headline", [540, 60, 930, 120], "HARBOR WORK STARTS"),
    ("right-1", "paragraph", [540, 132, 930, 214], "A revised plan passed review and lets the builders begin with the shoreline this week."),
    ("image-right-1", "image", [550, 224, 920, 404], None),
    ("caption-right-1", "caption", [550, 410, 920, 446], "Crews look at the wall before the heavy machines arrive."),
    ("right-2", "paragraph", [540, 458, 930, 562], "Engineers expect the first phase to end before the storms of the summer season come."),
    ("headline-left-2", "headline", [60, 344, 430, 404], "BOARD DELAYS VOTE"),
    ("left-3", "paragraph", [60, 416, 430, 502], "Members put off the vote after parents asked for more time to speak about it in public."),
    ("left-4", "paragraph", [60, 514, 430, 606], "A new calendar has two more hearings and a period for written answers from teachers."),
]


def payload(spark):
    nodes = [{k: v for k, v in zip(("id", "type", "bbox", "text"), b) if v is not None} for b in BLOCKS]
    text = json.dumps({"page_no": 1, "width": 1000, "height": 1400, "pages": [{"page_no": 1, "blocks": nodes}]})
    return spark.createDataFrame([(1, 1, 1000, 1400, text)], "doc_id long, page_no int, width int, height int, payload string")


def test_walk_keeps_every_block_once(spark):
    rows = payloads.flatten_payload_a(payload(spark)).collect()
    assert {r.block_id for r in rows} == {b[0] for b in BLOCKS}


def test_walk_enters_nodes_that_are_no_blocks_and_numbers_kept_ones(spark):
    part = {"bbox": [10, 10, 50, 50], "text": "part"}
    nodes = [{"bbox": [5, 5, 5, 5], "text": "no area", "lines": [part]}, {"bbox": [0, 60, 90, 90], "text": "whole", "lines": [
        {"bbox": [0, 60, 90, 70], "text": "line"}]}, part, {"page_no": 2, "bbox": [1, 1, 9, 9], "text": "elsewhere", "blocks": [
            {"bbox": [0, 95, 90, 99], "text": "child"}]}, {"id": "own", "bbox": [0, 100, 90, 110], "text": "named"}]
    df = payload(spark).withColumn("payload", F.lit(json.dumps({"blocks": nodes}))).union(payload(spark).select(
        F.lit(2), "page_no", "width", "height", F.lit("{broken")))
    rows = payloads.flatten_payload_a(df).orderBy("seq").collect()
    assert [(r.block_id, r.text) for r in rows] == [("block-0001", "part"), ("block-0002", "whole"), ("block-0003", "child"), ("own", "named")]


def test_two_columns_three_articles(spark):
    blocks = payloads.flatten_payload_a(payload(spark))
    columned = segment.build_columns(blocks)
    assert columned.select("column_index").distinct().count() == 2
    rows = segment.segment_pages(blocks).orderBy("article_index").collect()
    assert [r.column_index for r in rows] == [0, 0, 1]
    assert rows[0].article_text.startswith("COUNCIL") and rows[2].article_id == "page-0001-article-0003"
    assert (rows[2].x0, rows[2].y0) == (528.0, 48.0)


def test_pages_without_image_are_left_out(spark):
    blocks = payloads.flatten_payload_a(payload(spark))
    none = spark.createDataFrame([], "doc_id long, page_no int")
    assert segment.segment_pages(blocks, none).count() == 0


def test_kinds_are_inherited_and_other_pages_pruned(spark):
    text = json.dumps({"page_no": 1, "layout": {"type": "Section-Header", "children": [
        {"bbox": [0.1, 0.1, 0.5, 0.2], "text": "below a title"}, {"page_no": 2, "bbox": [1, 1, 50, 50], "text": "elsewhere"},
        {"type": "photo", "x": 10, "y": 20, "width": 30, "height": 40}]}})
    df = spark.createDataFrame([(1, 1, 1000, 1400, text)], "doc_id long, page_no int, width int, height int, payload string")
    rows = {r.label: r for r in payloads.flatten_payload_b(df).collect()}
    assert set(rows) == {"title", "image"}
    image = rows["image"]
    assert (image.x0, image.y0, image.x1, image.y1) == (10, 20, 40, 60)


def test_walk_hands_boxes_on_before_the_whole_batch_is_walked(spark, monkeypatch):
    monkeypatch.setattr(payloads, "PAYLOADS_AT_ONCE", 2)
    texts = ['{"blocks": [{"text": "a"}, {"text": "b"}]}', None, "no json", '{"text": "c"}', "[]"]
    df = spark.createDataFrame([(i, 1, 100, 100, t) for i, t in enumerate(texts)], "doc_id long, page_no int, width int, height int, payload string").coalesce(1)
    rows = payloads.walk(df, "b")
    assert sorted((r.doc_id, r.seq, r.text, r.size) for r in rows.collect()) == [(0, 0, "", 3), (0, 1, "a", 1), (0, 2, "b", 1), (3, 0, "c", 1)]
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
