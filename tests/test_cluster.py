"""Golden pages for the title-anchored clustering."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import cluster

W, H = 2480, 3509
SCHEMA = ("doc_id long, page_no int, width int, height int, seq int, block_id string, label string, x0 int, y0 int, x1 int, y1 int, "
          "text string, confidence double")


def page(spark, blocks, width=W, height=H, doc_id=1):
    rows = [(doc_id, 1, width, height, i, f"b{i}", label, *box, text, 0.8) for i, (label, box, text) in enumerate(blocks)]
    return spark.createDataFrame(rows, SCHEMA)


TWO_PAPERS = [
    ("title", (434, 558, 652, 646), "한겨레"),
    ("title", (1290, 558, 1587, 646), "한국일보"),
    ("text", (484, 646, 1242, 702), "2026년 1월 2일 금요일 019면 사람"),
    ("text", (1317, 646, 2046, 761), "2026년 1월 2일 금요일 A19면 경제"),
    ("title", (451, 723, 541, 783), "알림"),
    ("image", (1322, 814, 2014, 1221), ""),
    ("text", (449, 825, 1218, 1404), "왼쪽 기사의 본문이 여기에 길게 이어집니다."),
    ("title", (1322, 1295, 2019, 1361), "오른쪽 기사 제목"),
    ("text", (1317, 1435, 2026, 1895), "오른쪽 기사의 첫 문단입니다."),
    ("text", (1317, 1902, 2026, 2358), "오른쪽 기사의 둘째 문단입니다."),
    ("text", (1803, 2835, 2026, 2891), "홍길동 기자"),
]


def test_two_papers_on_one_page(spark):
    pages = cluster.cluster_pages(page(spark, TWO_PAPERS)).persist()
    left, right = cluster.articles(pages).orderBy("article_order").collect()
    assert (left.title, right.title) == ("알림", "오른쪽 기사 제목")
    assert (left.publication, right.publication) == ("한겨레", "한국일보")
    assert left.issue.parsed.issue_date == right.issue.parsed.issue_date == "2026-01-02"
    assert (left.issue.parsed.issue_page_label, right.issue.parsed.issue_page_label) == ("019면", "A19면")
    assert (left.issue.parsed.issue_section, right.issue.parsed.issue_section) == ("사람", "경제")
    assert right.body_text == "오른쪽 기사의 첫 문단입니다.\n오른쪽 기사의 둘째 문단입니다."
    image, = cluster.images(pages).collect()
    assert (image.article_key, image.x0, image.y0) == (right.article_key, 1322, 814)
    assert cluster.unassigned(pages).count() == 0
    pages.unpersist()


def test_markup_in_headers_and_titles(spark):
    blocks = [
        ("header", (252, 926, 548, 1007), "<p>문화일보</p>"),
        ("header", (1329, 929, 2229, 989), "<p>2026년 2월 13일 금요일 008면 외교안보</p>"),
        ("title", (339, 1045, 2117, 1157), "<h2>큰 제목이 여기 있다</h2>"),
        ("title", (292, 1319, 1200, 1403), "<h3>작은 제목 하나</h3>"),
        ("text", (282, 1508, 1207, 2158), "<p>■ 왼쪽 단의 본문입니다.</p>"),
        ("text", (1262, 1319, 2204, 1779), "<p>오른쪽 단의 본문입니다.</p>"),
        ("text", (1262, 1796, 2204, 2445), "<p>오른쪽 단의 다음 본문입니다.</p>"),
    ]
    article, = cluster.articles(cluster.cluster_pages(page(spark, blocks))).collect()
    assert "<" not in article.title and "<" not in article.body_text
    assert article.publication == "문화일보"
    assert article.issue.parsed.issue_date == "2026-02-13"
    assert article.issue.raw_issue_text == "2026년 2월 13일 금요일 008면 외교안보"


def test_page_headers_are_no_titles(spark):
    blocks = [
        ("header", (46, 239, 165, 263), "문화일보"),
        ("header", (593, 240, 961, 258), "2026년 2월 23일 월요일 008면 외교안보"),
        ("title", (82, 270, 920, 301), "넓은 제목이 두 단을 덮는다"),
        ("text", (60, 334, 333, 355), "전문가 인용"),
        ("text", (55, 374, 340, 593), "왼쪽 본문"),
        ("text", (653, 334, 952, 553), "오른쪽 본문"),
    ]
    article, = cluster.articles(cluster.cluster_pages(page(spark, blocks))).collect()
    assert article.title == "넓은 제목이 두 단을 덮는다"
    assert (article.title_x0, article.title_y0, article.title_x1, article.title_y1) == (82, 270, 920, 301)
    assert article.y0 == 270 and article.y1 >= 553
    assert "문화일보" not in article.body_text


def test_small_lone_picture_is_dropped(spark):
    blocks = [("title", (100, 500, 300, 540), "Headline stands alone here"), ("image", (100, 560, 320, 760), "")]
    assert cluster.articles(cluster.cluster_pages(page(spark, blocks))).count() == 0


def test_images_grow_the_article_one_by_one(spark):
    """The second picture is only in reach because the first one made the article taller."""
    blocks = [
        ("title", (100, 300, 700, 350), "First story with pictures"), ("text", (100, 370, 700, 420), "Body of the first story."),
        ("image", (100, 450, 700, 900), ""), ("image", (100, 920, 700, 1400), ""),
    ]
    pages = cluster.cluster_pages(page(spark, blocks))
    assert [i.image_order for i in cluster.images(pages).orderBy("image_order").collect()] == [1, 2]
    assert cluster.articles(pages).collect()[0].y1 == 1400


def test_cut_blocks_go_back_to_the_pool(spark):
    """A block behind a wide gap leaves the first title and is taken as a leftover by the nearest article."""
    blocks = [
        ("title", (100, 300, 700, 350), "First story of the day"), ("text", (100, 370, 700, 420), "Its only paragraph is short."),
        ("text", (100, 1500, 700, 1550), "A paragraph far below it."), ("title", (100, 1700, 700, 1750), "Second story of the day"),
        ("text", (100, 1770, 700, 1820), "Second body is longer than forty characters in all."),
    ]
    rows = cluster.articles(cluster.cluster_pages(page(spark, blocks))).orderBy("article_order").collect()
    assert len(rows) == 2
    assert "far below" in rows[1].body_text and "far below" not in rows[0].body_text


def test_captions_follow_their_pictures(spark):
    blocks = [
        ("title", (100, 300, 1500, 350), "A story with two pictures side by side"),
        ("image", (100, 380, 700, 800), ""), ("image", (900, 380, 1500, 800), ""),
        ("caption", (100, 810, 700, 840), "Left caption text"), ("caption", (900, 810, 1500, 840), "Right caption text"),
        ("text", (100, 880, 1500, 1000), "The body of this story goes on for a while."),
    ]
    pages = cluster.cluster_pages(page(spark, blocks))
    found = {(c.image_order, c.caption) for c in cluster.captions(pages).collect()}
    assert found == {(1, "Left caption text"), (2, "Right caption text")}


def test_titles_merge_and_keep_their_text(spark):
    blocks = [
        ("title", (100, 300, 700, 360), "The first line of it"), ("title", (100, 370, 700, 430), "and the second"),
        ("text", (100, 450, 700, 500), "The body of the article."),
    ]
    article, = cluster.articles(cluster.cluster_pages(page(spark, blocks))).collect()
    assert article.title == "The first line of it and the second"
    assert (article.title_y0, article.title_y1) == (300, 430)


@pytest.mark.parametrize("partitions", [1, 8])
def test_partitioning_does_not_matter(spark, partitions):
    blocks = page(spark, TWO_PAPERS).repartition(partitions).orderBy(F.rand(partitions))
    rows = cluster.articles(cluster.cluster_pages(blocks)).orderBy("article_order").collect()
    assert [r.title for r in rows] == ["알림", "오른쪽 기사 제목"]


def test_column_starts_match_a_plain_fold(spark):
    """Leader clustering one block at a time, with every group tried, gives the same columns."""
    import random

    rng = random.Random(5)
    for trial in range(20):
        xs = sorted(rng.randrange(0, 2480) for _ in range(rng.randrange(1, 60)))
        groups = []
        for x in xs:
            hit = next((g for g in groups if abs(x - sum(g) // len(g)) <= 124), None)
            if hit is None:
                groups.append([x])
            else:
                hit.append(x)
        expected = [g[0] for g in groups]
        df = spark.createDataFrame([(x,) for x in xs], "x0 int").groupBy("x0").count().agg(
            F.sort_array(F.collect_list(F.struct("x0", F.col("count").alias("n")))).alias("c"))
        starts = df.select(cluster.column_starts(F.col("c"), F.lit(124)).alias("s")).first().s
        assert starts == expected, trial
