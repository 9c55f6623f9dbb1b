"""SQL text for the oracles: string functions and fixed values spelled for DuckDB."""

from __future__ import annotations

from broadsheet.functions import newspaper as news
from broadsheet.functions.text import SPACE

# The entities that the pages hold. The ampersand comes last on purpose.
NAMED_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&bull;", "•"),
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {to if to.startswith('chr(') else lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub(x, f'{SPACE}+', ' ')})"


def compact(x: str) -> str:
    return sub(x, f"{SPACE}+", "")


def unescape(x: str) -> str:
    for entity, char in (*NAMED_ENTITIES, ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def tidy(x: str) -> str:
    x = sub(sub(x, r"[ \t]+\n", "chr(10)"), r"\n[ \t]+", "chr(10)")
    return strip(sub(x, r"\n{3,}", "chr(10) || chr(10)"))


def strip_markup(x: str) -> str:
    x = f"replace({unescape(x)}, chr(13), chr(10))"
    return tidy(sub(sub(x, r"(?i)<\s*br\s*/?\s*>", "chr(10)"), r"<[^>]+>", " "))


def clean_extracted(x: str) -> str:
    x = f"replace({unescape(x)}, chr(13), chr(10))"
    x = sub(sub(x, r"(?i)<\s*br\s*/?\s*>", "chr(10)"), r"(?i)</\s*(?:p|div|h[1-6]|li)\s*>", "chr(10)")
    return tidy(sub(x, r"<[^>]+>", ""))


def fragment_text(x: str) -> str:
    x = sub(unescape(x), r"(?i)<\s*br\s*/?\s*>", "chr(10)")
    x = sub(x, r"(?i)</\s*(?:td|th)\s*>\s*<\s*(?:td|th)\b[^>]*>", "chr(9)")
    x = sub(x, r"(?i)</\s*tr\s*>", "chr(10)")
    return tidy(sub(unescape(sub(x, r"<[^>]+>", "")), r"\r\n?", "chr(10)"))


def normalize(x: str) -> str:
    return squeeze(strip_markup(x))


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def among(x: str, values) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def slug(x: str, allowed: str, to: str, ends: str, default: str) -> str:
    return f"coalesce(nullif({sub(sub(strip(x), f'[^{allowed}]+', to), f'^[{ends}]+|[{ends}]+$', '')}, ''), {lit(default)})"


# -- newspaper predicates over normalised text -----------------------------------------------

def is_page_metadata(x: str) -> str:
    rest = strip(f"regexp_extract({x}, {lit(news.ISSUE_DATE + '(.*)$')}, 4)")
    return (f"({x} <> '' AND length({x}) <= 96 AND (starts_with({x}, '면 ') OR {matches(x, '^' + news.PAGE_LINE + '$')}"
            f" OR ({matches(x, news.ISSUE_DATE)} AND {matches(rest, news.AFTER_DATE)})))")


def is_publication(x: str) -> str:
    return (f"({has_any(f'lower({x})', ('.com', '.co.kr'))} OR (NOT {matches(x, '[0-9]')} AND NOT {has_any(x, ('년', '면'))}"
            f" AND length({x}) <= 24 AND ({among(x, news.PUBLICATIONS)} OR {matches(x, news.PUBLICATION_SUFFIX)})))")


def is_credit(x: str) -> str:
    bracketed = r"^\[[^\]]+\]$"
    return (f"({matches(x, bracketed)} OR {among(x, news.AGENCIES)} OR (contains(lower({x}), '.com') AND length({x}) <= 40)"
            f" OR (length({x}) <= 60 AND {has_any(x, news.REPORTER_WORDS)}) OR contains({x}, '@'))")


def strip_credit(x: str) -> str:
    for tail in news.CREDIT_TAILS:
        x = sub(x, tail, "")
    return strip(x)


def is_aux(x: str) -> str:
    return f"({matches(x, news.RELATED_MARK)} OR (contains({x}, '관련기사') AND length({x}) <= 20))"


def non_article(x: str) -> str:
    return f"({x} = '' OR {is_aux(x)} OR {is_publication(x)} OR {is_page_metadata(x)})"


def metadata_kind(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN NULL WHEN {is_page_metadata(x)} THEN 'issue' WHEN {is_publication(x)} THEN 'publication' END"


def looks_like_ad(x: str) -> str:
    offer = (f"{has_any(x, news.DISCOUNT_WORDS)} OR {has_any(x, news.CONTACT_WORDS)} OR contains({x}, '%') OR {matches(x, news.CURRENCY)}")
    digits = f"(length({x}) - length({sub(x, '[0-9]', '')}))"
    return f"({has_any(f'lower({x})', news.AD_WORDS)} OR (length({x}) <= 80 AND {digits} >= 4 AND ({offer})))"


# -- boxes -----------------------------------------------------------------------------------

def overlap(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) / least(greatest(1, {a}x1 - {a}x0), "
            f"greatest(1, {b}x1 - {b}x0)))")


def area(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * "
            f"greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))")
