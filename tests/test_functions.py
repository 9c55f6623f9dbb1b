"""Golden values of single functions and small operators."""

import difflib

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import geometry as geo
from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box
from broadsheet.operators import blocks as bl
from broadsheet.operators import extract as ex
from broadsheet.operators import models, registry, relevance


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_thousand_space_on_a_large_page(spark):
    df = one(spark, x0=100, y0=100, x1=900, y1=900)
    row = df.select(*geo.normalize_bbox(Box.named(), F.lit(2480), F.lit(3509)).columns()).first()
    assert tuple(row) == (248, 351, 2232, 3158)


@pytest.mark.parametrize("text, expected", [
    ("a &amp;lt; b", "a &lt; b"), ("&#48;&#x41;&#xB7;", "0A·"), ("&nbsp;x&copy;", " x©"), ("plain", "plain")])
def test_unescape(spark, text, expected):
    assert one(spark, t=text.replace(" ", " ")).select(tx.unescape(F.col("t"))).first()[0].replace(" ", " ") == expected.replace(" ", " ")


def test_unescape_reads_like_a_browser(spark):
    import html

    names = sorted(html.entities.html5)
    texts = [f"a&{n} b" for n in names[::3]] + [f"&{n.rstrip(';')}xyz;" for n in names[::5]] + [f"&#{n};" for n in [*range(300), 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x110000, 10 ** 12]]
    texts += ["&#x1f600 &#X41;&#x0;", "&&lt;&amp;amp;", "& &; &#; &#x; &notit; &amp", "&#38;lt;", "a" * 50 + "&" + "b" * 50 + ";", "&lt;&gt;" * 100, "", "&", "no", "&#x110000;&#x000041;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.unescape(F.col("t")).alias("u")).collect()
    wrong = [(texts[r.i], r.u, html.unescape(texts[r.i])) for r in rows if r.u != html.unescape(texts[r.i])]
    assert not wrong, wrong[:5]


def test_page_range_must_ascend(spark):
    df = one(spark, t="3-1")
    with pytest.raises(Exception, match="ascending"):
        df.select(tx.page_range(F.col("t"))).collect()


def test_table_fragment_becomes_rows(spark):
    html = ('<div data-bbox="100 100 900 900" data-label="Table"><table><tr><td>a</td><td>b</td></tr><tr><th>c</th><td></td><td>d</td></tr>'
            '<tr><td>lone</td></tr></table></div>')
    df = spark.createDataFrame([(1, 1, html)], "doc_id long, page_no int, markup string")
    row = bl.blocks_from_markup(df).first()
    assert row.label == "table" and row.text == "a\tb\nc\td" and row.table_rows == [["a", "b"], ["c", "d"]]


def test_picture_above_a_table_grows_it(spark):
    schema = "doc_id long, page_no int, width int, height int, seq int, block_id string, label string, x0 int, y0 int, x1 int, y1 int, has_rows boolean"
    df = spark.createDataFrame([(1, 1, 1000, 1400, 0, "t", "table", 200, 400, 800, 720, True), (1, 1, 1000, 1400, 1, "i", "image", 250, 250, 750, 380, False)], schema)
    medians = spark.createDataFrame([(1, 1, 20)], "doc_id long, page_no int, median_height int")
    rows = {r.block_id: r for r in bl.embed_images_in_tables(df, medians).collect()}
    assert (rows["t"].x0, rows["t"].y0, rows["t"].x1, rows["t"].y1, rows["t"].original_y0) == (200, 250, 800, 720, 400)
    assert rows["i"].embedded_in_table == "t"


def test_hot_hash_is_planned_by_path(spark):
    rows = [(f"/p/{i:05d}", "hot" if i % 3 == 0 else f"h{i}") for i in range(3000)]
    files = spark.createDataFrame(rows, "path string, content_hash string")
    done = spark.createDataFrame([("h1",)], "content_hash string")
    out = registry.plan_ingest(files, done)
    assert out.count() == 3000
    assert out.where("content_hash = 'hot' and skip_reason is null").collect()[0].path == "/p/00000"
    assert out.where("skip_reason is not null").count() == 1000 - 1 + 1
    assert registry.plan_ingest(files, done, force=True).where("skip_reason is not null").count() == 0


def test_ratio_is_that_of_matching_blocks(spark):
    a, b = "abcdefgh" * 40, "abcdxfgh" * 40
    row = one(spark, a=a, b=b).select(ex.field_similarity(F.col("a"), F.col("b"))).first()
    assert row[0] == difflib.SequenceMatcher(a=a, b=b).ratio()


def test_diff_lists_changed_lines(spark):
    row = ex.text_diff(one(spark, before="x\ny", after="x\nz")).first()
    assert row["diff"].splitlines()[:2] == ["--- before", "+++ after"] and "-y" in row["diff"] and row["similarity"] < 1


def test_model_must_answer_every_page(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_no int")
    with pytest.raises(Exception, match="unexpected number"):
        models.run_page_model(pages, lambda batch: [], 2).collect()
    with pytest.raises(ValueError):
        models.run_page_model(pages, lambda batch: [], 0)


def test_phrase_spelled_two_ways_counts_twice(spark):
    df = spark.createDataFrame([(1, 1, 1, "제목", "처리 경과를 설명")], "doc_id long, page_no int, article_order int, title string, body_text string")
    row = relevance.heuristic_relevance(relevance.prepare(df)).first()
    assert round(row.heuristic_score, 2) == 0.25 and row.heuristic_label == "low"


def test_bands_give_each_line_its_first_holder(spark):
    line = spark.createDataFrame([(1, 1, "l", 10, 500, 60, 540)], "doc_id long, page_no int, block_id string, x0 int, y0 int, x1 int, y1 int")
    regions = spark.createDataFrame([(1, 1, 1, "late", 0, 0, 100, 2000), (1, 1, 0, "early", 0, 100, 100, 1000), (1, 1, 2, "part", 0, 510, 100, 530)],
                                    "doc_id long, page_no int, seq int, label string, x0 int, y0 int, x1 int, y1 int")
    rows = bl.best_region(line, regions).collect()
    assert [r.region_label for r in rows] == ["early"]


def oracle_rows(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for path in sf_dir.iterdir():
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["clean_article_text", "clean_extracted_text", "fragment_to_text", "normalize_text", "strip_markup"])
def test_pages_cut_within_a_reference(spark, tmp_path, name):
    from broadsheet.plans import load_catalog

    htmls = ["<title>a&amp;&amp</title><p>b &amp;lt; c&am<i>p{x}</i></p>", "x &lt;b&gt; &copy; &copy &#38; &ltnot; &nbsp", "&amp;amp &am<b>p;</b> &middot;"]
    spark.createDataFrame(list(enumerate(h.replace("&#38; ", "") for h in htmls)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found, sql = load_catalog()
    assert sorted(tuple(r) for r in found[name](spark, str(tmp_path)).collect()) == oracle_rows(tmp_path, sql[name])


def test_box_of_the_first_thousandth(spark, tmp_path):
    from broadsheet.plans import load_catalog

    line = spark.createDataFrame([(1000, 1, 3000, 500, 1.0), (1000, 2, 3000, 500, 5.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    found, sql = load_catalog()
    rows = sorted(tuple(r) for r in found["bbox_from_model_value"](spark, str(tmp_path)).collect())
    assert rows == oracle_rows(tmp_path, sql["bbox_from_model_value"]) and rows[0][4:] == (0, 0, 2, 4)


def test_slugs_of_long_runs_of_marks_take_linear_time(spark):
    import time

    one(spark, t="warm").select(tx.slugify(F.col("t")), tx.normalize_reviewer(F.col("t"))).first()
    text, start = " -. a--b .c" + "._" * 60000 + "d e\n가나_- ", time.perf_counter()
    row = one(spark, t=text).select(tx.slugify(F.col("t")), tx.normalize_reviewer(F.col("t"))).first()
    assert tuple(row) == ("a-b-.c" + "._" * 60000 + "d-e", "a--b_.c" + "._" * 60000 + "d_e_가나")
    assert time.perf_counter() - start < 3


def test_lines_without_marks_pass_the_patterns_by(spark):
    import time

    from broadsheet.functions import newspaper as news

    def cleaned(text):
        return tuple(one(spark, t=text).select(tx.strip_markup(F.col("t")), news.strip_trailing_credit(F.col("t"))).first())

    assert cleaned(" a<br>b \n\n\n c&amp;d 서울=홍길동 기자 ") == ("a\nb\n\nc&d 서울=홍길동 기자", "a<br>b \n\n\n c&amp;d")
    text, start = "a" + " " * 200000 + "b", time.perf_counter()
    assert cleaned(text) == (text, text)
    assert time.perf_counter() - start < 5
