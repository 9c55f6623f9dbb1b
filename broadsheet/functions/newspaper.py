"""Conventions of Korean newspaper pages: headers, credits, advertisements, issue lines.

The predicates take text whose markup is already gone (``text.normalize_text``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import count_matches, strip

# Patterns of Korean page headers.
WEEKDAY = "(?:월요일|화요일|수요일|목요일|금요일|토요일|일요일)"
ISSUE_DATE = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
PAGE_NUMBER = r"[A-Za-z]?\d{1,3}"
PAGE_LINE = PAGE_NUMBER + r"\s*면(?:\s+\S.*)?"
AFTER_DATE = rf"^(?:{WEEKDAY}(?:\s+{PAGE_NUMBER}|\s+{PAGE_LINE})?|{PAGE_NUMBER}|{PAGE_LINE})?$"
PUBLICATION_SUFFIX = "(일보|신문|경제|헤럴드|타임즈|저널|뉴스|투데이)$"
RELATED_MARK = r"^[▶▸▷►]\s*관련\s*기사(?:[^\p{L}\p{N}_]|$)"

# Newspapers, agencies and words with a meaning of their own.
PUBLICATIONS = (
    "한겨레", "머니투데이", "아시아투데이", "한국경제", "한국일보", "경향신문", "국민일보",
    "서울신문", "세계일보", "문화일보", "내일신문", "동아일보", "조선일보", "중앙일보",
)
AGENCIES = ("연합뉴스", "뉴시스", "뉴스1")
REPORTER_WORDS = (" 기자", " 특파원", " correspondent", " reporter")
AD_WORDS = ("advertisement", "sponsored", "paid content", "광고", "전면광고")
DISCOUNT_WORDS = ("할인", "특가", "이벤트", "분양")
CONTACT_WORDS = ("문의", "상담", "예약", "대표번호")
CURRENCY = r"\d[\d,\.\s]*(원|만원|억원|천원|달러)"
CREDIT_WORDS = ("기자", "특파원")
CREDIT_TAILS = (
    r"\s+[가-힣A-Za-z]{1,20}=[가-힣A-Za-z]{2,20}\s+(?:기자|특파원)\s*$",
    r"\s+[가-힣A-Za-z]{2,20}\s+(?:기자|특파원)\s*$",
)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def ends_sentence(text: Column) -> Column:
    return F.endswith(text, F.lit("."))


def is_page_metadata(text: Column) -> Column:
    """A page-number line, or a date line followed by nothing but weekday, page and section."""
    rest = strip(F.regexp_extract(text, ISSUE_DATE + "(.*)$", 4))
    line = F.startswith(text, F.lit("면 ")) | text.rlike(f"^{PAGE_LINE}$")
    dated = text.rlike(ISSUE_DATE) & rest.rlike(AFTER_DATE)
    return (text != "") & (F.length(text) <= 96) & (line | dated)


def is_publication_header(text: Column) -> Column:
    """A web address, or a short name that is or looks like a newspaper's."""
    low = F.lower(text)
    site = contains_any(low, (".com", ".co.kr"))
    name = text.isin(*PUBLICATIONS) | text.rlike(PUBLICATION_SUFFIX)
    return site | (~text.rlike(r"\p{Nd}") & ~contains_any(text, ("년", "면")) & (F.length(text) <= 24) & name)


def metadata_kind(text: Column) -> Column:
    return F.when(text == "", None).when(is_page_metadata(text), "issue").when(is_publication_header(text), "publication")


def is_credit(text: Column) -> Column:
    return (
        text.rlike(r"^\[[^\]]+\]$")
        | text.isin(*AGENCIES)
        | (F.contains(F.lower(text), F.lit(".com")) & (F.length(text) <= 40))
        | ((F.length(text) <= 60) & contains_any(text, REPORTER_WORDS))
        | F.contains(text, F.lit("@"))
    )


def strip_trailing_credit(text: Column) -> Column:
    cut = text
    for tail in CREDIT_TAILS:
        cut = F.regexp_replace(cut, tail, "")
    # Both patterns end in one of these words and would try every blank of a text without them.
    return strip(F.when(contains_any(text, CREDIT_WORDS), cut).otherwise(text))


def is_aux_title(text: Column) -> Column:
    """The marker of a list of related articles."""
    return text.rlike(RELATED_MARK) | (F.contains(text, F.lit("관련기사")) & (F.length(text) <= 20))


def is_non_article_title(text: Column) -> Column:
    return (text == "") | is_aux_title(text) | is_publication_header(text) | is_page_metadata(text)


def is_short_title(text: Column, limit: int = 72) -> Column:
    return (text != "") & (F.length(text) <= limit) & ~ends_sentence(text)


def is_caption_title(text: Column) -> Column:
    return is_short_title(text, 64)


def looks_like_ad(text: Column) -> Column:
    """An advertising word, or a short text of digits with a discount, contact, percent or price."""
    offer = (
        contains_any(text, DISCOUNT_WORDS) | contains_any(text, CONTACT_WORDS)
        | F.contains(text, F.lit("%")) | text.rlike(CURRENCY)
    )
    digits = count_matches(text, r"\p{Nd}")
    return contains_any(F.lower(text), AD_WORDS) | ((F.length(text) <= 80) & (digits >= 4) & offer)


def parse_issue_metadata(text: Column) -> Column:
    """Struct of date, weekday, page and section of an issue line; null where there is no date.

    The date is printed from its digits, so an impossible one passes unchanged.
    """
    pattern = ISSUE_DATE + rf"(?:\s*({WEEKDAY}))?(.*)$"

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    year, month, day = (part(i).try_cast("int") for i in (1, 2, 3))
    weekday = F.nullif(part(4), F.lit(""))
    rest = strip(part(5))
    labelled = rf"^({PAGE_NUMBER})\s*면(?:\s*(.+))?$"
    page = F.coalesce(
        F.nullif(F.regexp_extract(rest, labelled, 1), F.lit("")),
        F.nullif(F.regexp_extract(rest, f"^({PAGE_NUMBER})$", 1), F.lit("")),
    )
    section = F.nullif(F.trim(F.regexp_extract(rest, labelled, 2)), F.lit(""))
    return F.when(
        (F.length(text) <= 96) & text.rlike(ISSUE_DATE),
        F.struct(
            F.format_string("%04d-%02d-%02d", year, month, day).alias("issue_date"),
            F.concat_ws(" ", F.format_string("%d년 %d월 %d일", year, month, day), weekday).alias("issue_date_text"),
            weekday.alias("issue_weekday"),
            page.alias("issue_page"),
            F.concat(page, F.lit("면")).alias("issue_page_label"),
            section.alias("issue_section"),
        ),
    )
