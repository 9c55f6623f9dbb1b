"""Files, bundles and training sets on disk."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from broadsheet.operators import annotations
from broadsheet.sources import bundles, files, sinks


def test_scan_takes_known_suffixes_in_path_order(spark):
    root = tempfile.mkdtemp(prefix="scan-")
    os.makedirs(f"{root}/sub")
    for name in ("b.PDF", "sub/a.png", "c.txt", "d.webp"):
        with open(f"{root}/{name}", "wb") as out:
            out.write(b"%PDF-" + name.encode())
    rows = files.scan_source_files(spark, root, with_content=True).collect()
    assert [r.file_name for r in rows] == ["b.PDF", "d.webp", "a.png"]
    assert all(len(r.content_hash) == 64 for r in rows)
    assert "content" not in files.scan_source_files(spark, root).columns


def test_bundles_round_trip_and_keys_from_path(spark):
    root = tempfile.mkdtemp(prefix="bundles-")
    good = f"{root}/job_20240131_a/paper/parsed/page_0003/article_02_x"
    bad = f"{root}/job_20240131_a/paper/parsed/page_0003/article_03_y"
    for folder in (good, bad):
        os.makedirs(folder)
    with open(f"{good}/article.json", "w") as out:
        json.dump({"title": "T", "body_text": "B", "images": []}, out)
    with open(f"{bad}/article.json", "w") as out:
        out.write("{broken")
    rows = bundles.read_article_bundles(spark, root).collect()
    row = next(r for r in rows if r.title == "T")
    assert (row.job_key, row.pdf_slug, row.page_number, row.article_order, row.pdf_file) == ("job_20240131_a", "paper", 3, 2, "paper")


def test_page_payloads_keep_their_number(spark):
    root = tempfile.mkdtemp(prefix="payloads-")
    with open(f"{root}/page_0007_vl.json", "w") as out:
        json.dump({"blocks": []}, out)
    row = bundles.read_page_payloads(spark, root).select("page_no", "payload").first()
    assert row.page_no == 7 and json.loads(row.payload) == {"blocks": []}


def test_article_records_are_written_by_page(spark):
    root = tempfile.mkdtemp(prefix="records-")
    df = spark.createDataFrame([("job", "pdf", 1, "a1", "T")], "job_key string, pdf_slug string, page_number int, article_id string, title string")
    df = df.withColumns({"images": F.array().cast("array<string>"), "captions": F.array(F.lit("c"))})
    sinks.write_article_bundles(df, root)
    row = spark.read.text(f"{root}/job_key=job/pdf_slug=pdf/page_number=1").first()
    record = json.loads(row.value)
    assert record["image_count"] == 0 and record["caption_count"] == 1 and record["title"] == "T"


def test_training_numbers_have_holes(spark):
    records = spark.createDataFrame([(i, "job_20240101_a", "p", i, 1) for i in (1, 2, 3)], "article_id long, job_key string, pdf_slug string, page_number long, article_order int")
    schema = "article_id long, status string, corrected_title string, corrected_body_text string, title_bbox array<int>, article_bbox array<int>"
    notes = spark.createDataFrame([(1, "accepted", "t", "b", [0, 0, 1, 1], [0, 0, 2, 2]), (2, "rejected", "t", "b", None, None),
                                   (3, "accepted", "", "b", None, [0, 0, 2, 2])], schema)
    root = tempfile.mkdtemp(prefix="training-")
    counts = annotations.export_training_set(records, notes, root).first()
    assert tuple(counts) == (2, 1, 2)
    paths = sorted(r.image_path for r in spark.read.json(f"{root}/document_article").collect())
    assert paths == ["document_article/article_000001.png", "document_article/article_000003.png"]


def exchanges(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_best_article_shuffles_once(spark):
    from broadsheet.operators import reports

    schema = "job_id long, article_id string, title string, body_length int, image_count int, relevance_score double, article_order int"
    rows = [(1, "a", "t" * 30, 200, None, 0.5, 2), (1, "b", "t" * 30, 200, 0, 0.5, 3), (1, "c", "t" * 30, 200, 0, 0.5, 1), (1, "d", "t" * 30, 900, 9, None, 0),
            (2, "e", "", 200, 1, 0.1, 1), (2, "f", "t" * 30, 200, 1, 0.1, 2)]
    best = reports.best_article(spark.createDataFrame(rows, schema), ["article_order"])
    assert exchanges(best) == 1
    assert sorted(map(tuple, best.collect())) == [(1, "c"), (2, "f")]


def test_captions_are_shuffled_once_and_grouped_by_hash(spark):
    from pyspark.sql import functions as F

    from broadsheet.sources import captions as cp

    text = '[{"text":" a ","bbox":[1, 2,30,40],"confidence":0.5},{"content":"a","bbox":"[30,40,1,2]"},{"text":"　","content":"b"},{"text":" "},{"text":"c","confidence":0.1}]'
    rows = [("x", 1, 0, text), ("x", 2, 5, '[{"text":"c"}]'), ("x", 2, 5, '[{"text":"d"},{"text":"c","confidence":0.9}]'), ("y", None, None, '[{"text":"c"}]')]
    images = spark.createDataFrame(rows, "article_id string, position int, image_order int, captions string")
    plain, scaled = cp.normalize_captions(images), cp.normalize_captions(images, F.lit(2480), F.lit(3509))
    flat, mapped = cp.flatten_captions(plain), cp.captions_by_image(plain.where("image_order is not null"))
    assert [exchanges(df) for df in (plain, scaled, flat, mapped)] == [1, 1, 1, 1]
    for df in (plain, scaled, flat):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    found = {(r.article_id, r.image_order, r.caption, r.x0, r.y1, r.caption_order, r.confidence) for r in plain.collect()}
    assert found == {("x", 1, "a", 1, 40, 0, 0.5), ("x", 1, "b", None, None, 2, None), ("x", 1, "c", None, None, 4, 0.1), ("x", 5, "c", None, None, 0, None),
                     ("x", 5, "d", None, None, 0, None), ("y", None, "c", None, None, 0, None)}
    assert {(r.x0, r.y0, r.x1, r.y1) for r in scaled.where("caption = 'a'").collect()} == {(2, 7, 74, 140)}
    assert {(r.article_id, r.caption, r.image_order, r.caption_order) for r in flat.collect()} == {
        ("x", "a", 1, 0), ("x", "b", 1, 2), ("x", "c", 1, 4), ("x", "d", 5, 0), ("y", "c", None, 0)}
    assert mapped.first().captions == {1: ["a", "b", "c"], 5: ["c", "d"]}


def shuffles(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return exchanges(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_links_shuffle_pages_twice(spark):
    from broadsheet.operators import reports

    rows = [(1, 11, "a", 1), (1, 11, "b", 2), (1, 11, "c", 3), (1, 12, "d", 1), (1, 13, "e", 2), (1, 13, "f", 2), (2, 21, "g", 1), (2, None, "h", 1)]
    links = reports.page_links(spark.createDataFrame(rows, "job_id long, file_id long, page_id string, page_number int"))
    assert shuffles(spark, links) == 2
    assert sorted(map(tuple, links.collect())) == [("a", None, "b"), ("b", "a", "c"), ("c", "b", "d"), ("d", "c", "e"), ("e", "d", "f"), ("f", "e", None), ("g", None, None)]


def test_article_detail_shuffles_only_the_texts_chosen(spark):
    from broadsheet.operators import reports

    own = spark.createDataFrame([(1, "x", "p", "own", " "), (1, "y", "p", "own", "text")], "job_id long, article_id string, page_id string, title string, body_text string")
    pages = spark.createDataFrame([(1, 11, "p", 1)], "job_id long, file_id long, page_id string, page_number int")
    part = spark.createDataFrame([("x", " t ", " ")], "article_id string, corrected_title string, corrected_body_text string")
    raw = spark.createDataFrame([("x", "raw")], "article_id string, raw_text string")
    detail = reports.article_detail(own, pages, part, part.limit(0), part.limit(0), raw)
    plan = detail._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "page_id" in plan.left().output().toString() and "m_title" not in plan.left().output().toString()
    assert sorted(tuple(r) for r in detail.select("article_id", "corrected_title", "corrected_body_text").collect()) == [("x", "t", "raw"), ("y", "own", "text")]


def test_job_result_shuffles_pictures_and_captions_together(spark):
    from broadsheet.operators import reports

    own = spark.createDataFrame([(1, "x", "own", "b"), (1, "y", "own", "b")], "job_id long, article_id string, title string, body_text string")
    images = spark.createDataFrame([("x", 2, "p2"), ("x", 1, "p1"), ("x", 2, None), ("x", None, "p0")], "article_id string, image_order int, image_path string")
    words = spark.createDataFrame([("x", 2, 2, "d"), ("x", 2, 1, "c"), ("x", None, 1, "n"), ("y", 1, 1, "lost")], "article_id string, image_order int, caption_order int, caption string")
    meta = spark.createDataFrame([("x", " t ", " ")], "article_id string, corrected_title string, corrected_body_text string")
    sent = spark.createDataFrame([("y", "failed")], "article_id string, delivery_status string")
    out = reports.job_result(own, images, words, meta, sent)
    assert shuffles(spark, out) == 4
    found = {r.article_id: [(i.image_order, i.image_path, i.captions) for i in r.images] for r in out.collect()}
    assert found == {"x": [(None, "p0", []), (1, "p1", []), (2, None, ["c", "d"]), (2, "p2", ["c", "d"])], "y": []}


def test_job_browser_deals_articles_out_by_page_once(spark):
    from broadsheet.operators import reports

    files = spark.createDataFrame([(11, "f", "completed")], "file_id long, file_name string, status string")
    pages = spark.createDataFrame([("p", "parsed")], "page_id string, status string")
    arts = spark.createDataFrame([(1, 11, "p", 1, 2, "b", "B"), (1, 11, "p", 1, 1, "a", "A")], "job_id long, file_id long, page_id string, page_number int, article_order int, article_id string, title string")
    fix = spark.createDataFrame([("a", "A2")], "article_id string, corrected_title string")
    out = reports.job_browser(files, pages, arts, fix, spark.createDataFrame([("z", "Z")], fix.schema))
    # Three by article, two by page, two by file.
    assert shuffles(spark, out) == 7
    row, = out.collect()
    assert [(a.title, a.annotated) for a in row.articles] == [("A2", True), ("B", False)] and row.article_count == 2 and row.file_name == "f"


def test_latest_delivery_shuffles_no_order_beside_the_state(spark):
    from broadsheet.operators import delivery

    rows = [("t1", "x", 5, "failed"), ("t2", "x", 5, "delivered"), ("t9", "x", 4, "failed"), ("t1", "y", None, "failed")]
    ledger = spark.createDataFrame(rows, "attempt_id string, article_id string, attempted_at long, delivery_status string")
    last = delivery.latest_delivery(ledger)
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString() and last.columns == ["article_id", "attempt_id", "attempted_at", "delivery_status"]
    assert sorted(map(tuple, last.collect())) == [("x", "t2", 5, "delivered"), ("y", "t1", None, "failed")]


def test_ledger_shuffles_requests_by_attempt_alone(spark):
    from broadsheet.operators import delivery

    requests = spark.createDataFrame(
        [(t, n, i, f"{t}{i}", "{}", 1) for t, n in (("gone", 2), ("refused", 3), ("gaps", 3), ("late", 1)) for i in range(n)] + [(None, 2, 0, "none", "{}", 1), ("refused", 3, None, "unplaced", "{}", 1)],
        "attempt_id string, batch_size int, article_index int, article_id string, request_article string, attempted_at long")
    responses = spark.createDataFrame(
        [("refused", None, 400, "e", "t"), ("refused", 1, 422, None, " "), ("refused", 0, 200, None, None), ("gaps", None, 400, None, "t"), ("gaps", 2, 200, None, None), ("gaps", 2, 500, "x", None),
         ("late", None, 503, None, "busy"), ("late", None, 202, None, None), ("late", 0, 200, None, None), (None, None, 200, None, None), (None, 0, 200, None, None), ("lost", 0, 200, None, None)],
        "attempt_id string, article_index int, response_code int, error_code string, response_text string")
    ledger = delivery.delivery_ledger(requests, responses)
    assert shuffles(spark, ledger) == 2
    found = sorted((r.article_id, r.response_code, r.last_error, r.request_batch_size, r.request_article_index) for r in ledger.collect())
    assert found == sorted([
        ("gone0", 502, "HTTP 502", 2, 0), ("gone1", 502, "HTTP 502", 2, 1), ("refused0", 200, None, 1, 0), ("refused1", 422, "HTTP 422", 1, 0), ("refused2", 502, "HTTP 502", 1, 0),
        ("gaps0", 502, "HTTP 502", 1, 0), ("gaps1", 502, "HTTP 502", 1, 0), ("gaps2", 200, None, 1, 0), ("gaps2", 500, "target rejected: x", 1, 0),
        ("late0", 503, "busy", 1, 0), ("late0", 202, None, 1, 0), ("none", 502, "HTTP 502", 2, 0), ("unplaced", 502, "HTTP 502", 1, 0)])


def _delivery(spark):
    from broadsheet.operators import delivery
    kinds = "article_id string, job_id long, file_id long, page_number int, title string, body_text string, publication string, issue_date string, relevance_score string"
    articles = spark.createDataFrame([
        ("a", 1, 11, 1, " T　", "b", "p", "2024-05-06 ", "50"), ("b", 1, 11, 2, "T", "b", "p", "2024-02-30", None),
        ("c", 1, 10, 9, " ", "b", None, None, "x"), ("d", 2, 20, 1, "T", "\n", "p", "", "1")], kinds)
    images = spark.createDataFrame([
        ("a", 3, "a/3", [None, "　three ", " \t"]), ("a", 1, "a/1", None), ("a", 2, "a/2", ["two", " more"]), ("a", 4, "a/4", ["large"]),
        ("c", 1, "c/1", ["gone"]), ("c", 2, "c/2", ["gone"]), ("c", 3, "c/3", ["large"]), ("none", 1, "n/1", ["n"])],
        "article_id string, image_order int, image_path string, captions array<string>")
    sizes = spark.createDataFrame([("a/1", 5), ("a/2", 5), ("a/3", 5), ("a/4", 11 << 20), ("c/3", 11 << 20), ("n/1", 1)], "image_path string, size_bytes long")
    return delivery, articles, images, sizes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_request_collects_pictures_in_order_without_grouping_by_hash(spark):
    delivery, articles, images, sizes = _delivery(spark)
    numbered = delivery.index_in_job(delivery.prepare_articles(articles), ["page_number"])
    found = delivery.request_body(delivery.with_images(numbered, images, sizes))
    body = {r.article_id: json.loads(r.request_article) for r in found.collect()}
    assert {k: v for k, v in body["a"].items() if k != "imgs"} == {"title": "T", "body_text": "b", "relevance_score": 0.5, "publication": "p", "issue_date": "2024-05-06"}
    assert [(i["caption"], i["src"]) for i in body["a"]["imgs"]] == [("", "file_1_0"), ("two more", "file_1_1"), ("three", "file_1_2")]
    assert body["b"]["issue_date"] == "2024-02-30" and body["b"]["imgs"] == body["c"]["imgs"] == [] and set(body) == set("abcd")
    plan = _plan(found.select("article_id", "request_article"))
    assert "ObjectHashAggregate" not in plan and "get_json_object" not in plan
    from broadsheet.plans import load_catalog
    query = _plan(load_catalog()[0]["delivery_request"](spark, "/root/testdata/sf0.001"))
    assert "ObjectHashAggregate" not in query and "get_json_object" not in query


def test_truncating_trims_every_kind_of_blank(spark):
    from broadsheet.functions import text as tx
    texts = [None, "", " ", "　 x ", "\t　", "ab  cdef", " a   b ", "가나 다", "abc\n d", "\x85abc "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.truncate_text(F.col("t"), 4).alias("cut"), tx.strip_named(F.col("t")).alias("bare"))
    for r in rows.collect():
        assert r.cut == (r.t or "").strip()[:4].strip() and r.bare == (None if r.t is None else r.t.strip())


def test_preview_groups_jobs_once_and_leaves_the_texts_behind(spark):
    delivery, articles, images, sizes = _delivery(spark)
    made = delivery.delivery_preview(delivery.prepare_delivery(articles, images, sizes))
    out = {r.job_id: r.asDict() for r in made.collect()}
    assert out[1] == {"job_id": 1, "ready_count": 1, "warning_count": 1, "blocked_count": 1, "article_count": 3, "included_images": 3, "skipped_images": 4, "delivery_status": "blocked",
                      "validation_summary": ["image_too_large", "image_missing_file", "missing_issue_date", "missing_publication", "missing_title"]}
    assert out[2]["validation_summary"] == ["missing_body", "missing_issue_date"] and out[2]["included_images"] == 0 and out[2]["blocked_count"] == 1
    off = delivery.delivery_preview(delivery.prepare_delivery(articles, images, sizes), target_configured=False)
    assert {r.job_id: r.validation_summary[-1] for r in off.collect()} == {1: "target_not_configured", 2: "target_not_configured"}
    plan = _plan(made)
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan
