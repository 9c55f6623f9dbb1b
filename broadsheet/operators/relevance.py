"""Relevance of articles: keyword heuristic, and model replies laid over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx

# Keywords by group, and the sentences of the reasons.
DIRECT = ("국회", "국방위", "국방위원회", "국정감사", "자료제출", "질의", "답변", "보고", "청문회")
ADMIN = ("처리경과", "처리 경과", "결과", "기록", "현황", "통계", "수치", "예산")
INCIDENT = ("사고", "사망", "부상", "실종", "훈련사고", "안전사고")
STRONG = ("국회", "국방위", "국방위원회", "국정감사")
ARMY = ("육군", "군")
REASONS = {
    "direct_context": ("국회 관련 키워드(", ")와 보고/사건 맥락이 함께 보여 국회 업무 연관성이 높습니다."),
    "direct": ("국회 관련 키워드(", ")가 직접 보여 국회 업무와 연결됩니다."),
    "incident": ("사고/사망 관련 키워드(", ")가 보여 국회 질의나 보고 가능성이 있습니다."),
    "admin_high": ("처리 경과/결과/기록 키워드(", ")가 보여 국회 응답 자료와 연결됩니다."),
    "admin_low": ("국회 요청 맥락은 약하지만 처리 경과/결과 키워드(", ")가 일부 보입니다."),
    "none": "국회 요청, 보고, 자료제출 맥락이 약해 일반 군사 뉴스에 가깝습니다.",
    "model": "국회 업무와의 관련성을 LLM이 판단했습니다.",
}


def prepare(articles: DataFrame) -> DataFrame:
    """Adds the title and body as they are judged: cleaned and cut; a missing body is the title."""
    title = tx.clean_article_text(F.col("title"), 220)
    body = tx.clean_article_text(F.col("body_text"), 1800, keep_newlines=True)
    out = articles.withColumns({"judged_title": title, "judged_body": body})
    return out.withColumn("judged_body", F.coalesce(F.nullif("judged_body", F.lit("")), F.col("judged_title")))


def label_for(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low")


def heuristic_relevance(articles: DataFrame) -> DataFrame:
    """Adds ``heuristic`` score, label and reason from the keywords in ``judged_*``.

    Keywords are sought without their blanks, so a phrase spelled two ways counts twice.
    """
    squashed = tx.compact(tx.unescape(F.concat_ws("\n", "judged_title", "judged_body")))
    out = articles.withColumn("_t", squashed)

    def found(words: tuple[str, ...]) -> Column:
        return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("_t"), F.replace(w, F.lit(" "), F.lit(""))))

    out = out.withColumns({"_d": found(DIRECT), "_a": found(ADMIN), "_i": found(INCIDENT)})
    d, a, i = F.col("_d"), F.col("_a"), F.col("_i")
    army = F.contains("_t", F.lit(ARMY[0])) | F.contains("_t", F.lit(ARMY[1]))
    strong = F.arrays_overlap(d, F.array(*map(F.lit, STRONG)))
    score = (F.lit(0.05) + F.least(F.lit(0.24), 0.18 * F.size(d)) + F.least(F.lit(0.20), 0.10 * F.size(a))
             + F.least(F.lit(0.18), 0.09 * F.size(i)) + F.when(army, 0.04).otherwise(0.0) + F.when(strong, 0.12).otherwise(0.0))
    out = out.withColumn("heuristic_score", F.greatest(F.lit(0.0), F.least(score, F.lit(0.98))))

    def sentence(key: str, words: Column) -> Column:
        before, after = REASONS[key]
        return F.concat(F.lit(before), F.array_join(F.slice(words, 1, 4), ", "), F.lit(after))

    context = (F.size(a) > 0) | (F.size(i) > 0)
    reason = (
        F.when((F.size(d) > 0) & context, sentence("direct_context", d)).when(F.size(d) > 0, sentence("direct", d))
        .when(F.size(i) > 0, sentence("incident", i))
        .when((F.size(a) > 0) & (F.col("heuristic_score") >= 0.4), sentence("admin_high", a))
        .when(F.size(a) > 0, sentence("admin_low", a)).otherwise(F.lit(REASONS["none"])))
    return out.withColumns({"heuristic_label": label_for(F.col("heuristic_score")), "heuristic_reason": reason}).drop("_t", "_d", "_a", "_i")


# Names a reply may use for a field; the first one that is neither missing, blank nor 0 counts.
REPLY_FIELDS = {
    "article_order": ("article_order", "index", "article_no"),
    "score": ("score", "relevance_score", "similarity"),
    "reason": ("reason", "explanation", "summary"),
    "label": ("label", "decision"),
    "corrected_title": ("corrected_title", "edited_title", "normalized_title"),
    "corrected_body_text": ("corrected_body_text", "corrected_body", "edited_body", "normalized_body"),
}


def reply_items(replies: DataFrame, page: list[str]) -> DataFrame:
    """One row per article a page's reply speaks of; a repeated article counts by its last entry."""
    names = sorted({n for names in REPLY_FIELDS.values() for n in names})
    item_type = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    parsed = replies.select(*page, tx.reply_json(F.col("reply")).alias("json")).where(F.col("json").isNotNull())
    parsed = parsed.withColumns({
        "items": F.from_json(F.get_json_object("json", "$.articles"), f"array<{item_type}>"),
        "single": F.from_json("json", item_type)})
    has_list = F.startswith(F.get_json_object("json", "$.articles"), F.lit("["))
    one = F.coalesce(*[F.col(f"single.{n}") for n in REPLY_FIELDS["score"]]).isNotNull()
    items = F.when(F.coalesce(has_list, F.lit(False)), F.col("items")).when(one, F.array("single"))
    rows = parsed.select(*page, F.posexplode(items).alias("pos", "i"), F.coalesce(has_list, F.lit(False)).alias("listed"))

    def pick(field: str) -> Column:
        # Python's "or": zero and the empty string fall through to the next name.
        usable = [F.when((F.col(f"i.{n}") != "") & ~F.col(f"i.{n}").rlike(r"^-?0+(\.0*)?$"), F.col(f"i.{n}")) for n in REPLY_FIELDS[field]]
        return F.coalesce(*usable, F.col(f"i.{REPLY_FIELDS[field][-1]}"))

    chosen = [pick(f).alias(f) for f in REPLY_FIELDS if f != "article_order"]
    order = F.coalesce(pick("article_order"), F.when(~F.col("listed"), F.lit("1"))).try_cast("int")
    rows = rows.select(*page, "pos", order.alias("article_order"), *chosen).where(F.col("article_order").isNotNull())
    rest = [f for f in REPLY_FIELDS if f != "article_order"]
    last = rows.groupBy(*page, "article_order").agg(F.max_by(F.struct(*rest), "pos").alias("r"))
    return last.select(*page, "article_order", "r.*")


def apply_model_replies(articles: DataFrame, replies: DataFrame, page: list[str], model: str = "model") -> DataFrame:
    """Assessments: the model's where it gives a usable score, else the heuristic's, per article."""
    judged = heuristic_relevance(prepare(articles))
    answered = reply_items(replies, page).withColumnsRenamed({f: f"r_{f}" for f in REPLY_FIELDS if f != "article_order"})
    out = judged.join(answered, [*page, "article_order"], "left").withColumn("r_score", tx.normalize_score(F.col("r_score")))
    by_model = F.col("r_score").isNotNull()
    label = F.lower(tx.strip(F.col("r_label")))
    corrected = {
        "corrected_title": (tx.clean_article_text(F.col("r_corrected_title"), 220), tx.clean_article_text(F.col("judged_title"), 220)),
        "corrected_body_text": (tx.clean_article_text(F.col("r_corrected_body_text"), 2000, True),
                                tx.clean_article_text(F.col("judged_body"), 2000, True)),
    }
    reason = F.coalesce(F.nullif(tx.clean_article_text(F.col("r_reason")), F.lit("")), F.lit(REASONS["model"]))
    return out.select(
        *page, "article_order", F.coalesce("r_score", "heuristic_score").alias("score"),
        F.when(by_model, F.when(label.isin("high", "medium", "low"), label).otherwise(label_for(F.col("r_score"))))
        .otherwise(F.col("heuristic_label")).alias("label"),
        F.when(by_model, reason).otherwise(F.col("heuristic_reason")).alias("reason"),
        F.when(by_model, "llm").otherwise("heuristic").alias("source"), F.when(by_model, F.lit(model)).alias("model"),
        *[F.when(by_model, F.coalesce(F.nullif(new, F.lit("")), old)).alias(n) for n, (new, old) in corrected.items()],
        F.col("r_score").isNotNull().alias("by_model"), F.col("r_reason").isNotNull().alias("answered"))


def page_source(assessments: DataFrame, page: list[str]) -> DataFrame:
    """Where a page's assessments come from: llm, mixed or heuristic."""
    sums = assessments.groupBy(*page).agg(
        F.count_if(F.col("source") == "llm").alias("m"), F.count_if(F.col("source") != "llm").alias("h"))
    source = F.when((F.col("m") > 0) & (F.col("h") > 0), "mixed").when(F.col("m") > 0, "llm").otherwise("heuristic")
    return sums.select(*page, source.alias("source"))
