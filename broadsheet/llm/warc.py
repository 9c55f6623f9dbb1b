r"""WARC (1): archives written and read as text, transactions joined through concurrent-to identifiers.

Writing: each page gives a request, a response (or revisit) and a metadata record. The first page, by id, of those with
one payload digest is the response; the others revisit it, so their payload is written once. Records are rows of
Spark's text writer, one row per record with a line end after it, gzipped: the files are plain WARC.

Reading: Spark's text reader, with ``\r\nWARC/1.`` as its line end, gives one row per record of WARC 1.0 and 1.1 and splits
uncompressed archives. The writer keeps that string out of blocks: a payload that holds ``WARC/1.`` is sent chunked
(RFC 9112), with a chunk's end inside the string. Chunks are joined in one pass over the body, by an Arrow function that sees chunked bodies
only, so very long payloads take linear time. A record whose block is shorter than its Content-Length, as a foreign
archive could give, has ``truncated`` set.

Assembly: every record but the responses looks for its capture through WARC-Concurrent-To, in either direction and over
at most one other record between; all of a capture meet in one nested row. Payloads are measured before the shuffle
and travel only if asked for.

Null html is an empty payload, a null url ``about:blank``; a null page_id makes a capture without page_id, later than
all others for the choice of response. Repeated rows are captures of their own, with record ids of their own; rows of
the response's id and payload are all responses. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import let, shared_path, stored, table

SALTS = 64
_EOL = "\r\n"
_MARK = "WARC/1.0"
_START = "WARC/1."
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 form of SHA-1; 40 hex digits are 8 groups of 20 bits, hence of 4 base32 digits."""
    group = lambda digits, k: F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0")
    digits = let(F.sha1(payload), lambda digits: F.concat(*(group(digits, k) for k in range(8))))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def choose_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload, ...) with digest, size, and refers_to: the response's page_id, null for responses.

    Only digests met twice are joined back, over SALTS rows each, so a payload that a third of the pages share meets
    no task alone.
    """
    pages = pages.withColumns({
        "digest": base32_sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    keyed = pages.withColumns({
        "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)),
        "rank": F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"))})
    shared = (
        keyed.filter(F.col("size") >= min_bytes).groupBy("digest", "salt").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
        .groupBy("digest").agg(F.min("rank").alias("first"), F.sum("n").alias("n")).filter("n > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")))
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return keyed.join(shared, ["digest", "salt"], "left").select(
        *pages.columns, F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    parts: list[Column] = []
    for name, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")))
    return F.concat(*parts)


def _record(kind: Column | str, rid: Column, content_type: str, block: Column, *more: tuple[str, Column | str]) -> Column:
    head = _headers(("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", _DATE), *more, ("Content-Type", content_type),
                    ("Content-Length", F.octet_length(block)))
    return F.concat(F.lit(_MARK + _EOL), head, F.lit(_EOL), block, F.lit(_EOL))


def _chunked(payload: Column) -> Column:
    """The payload as HTTP chunks, cut inside each ``WARC/1.``."""
    pieces = F.split(payload, "(?<=WARC/)(?=1\\.)")
    size = lambda p: F.lower(F.hex(F.octet_length(p)))
    return F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(size(p), F.lit(_EOL), p, F.lit(_EOL))), ""),
                    F.lit("0" + _EOL + _EOL))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """WARC files of ``pages`` (page_id, url, html) in folder ``path``."""
    clean = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\s\x00-\x1f]", "%20")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    chosen = choose_responses(pages, min_bytes)
    rid = lambda role: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias(role)
    chosen = chosen.select("*", rid("response_id"), rid("request_id"), rid("metadata_id"))
    marked = F.contains("payload", F.lit(_START)) & ~F.col("revisit")
    body = F.when(F.col("revisit"), "").when(marked, _chunked(F.col("payload"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + _EOL),
        _headers(("Content-Type", "text/html; charset=utf-8"),
                 ("Transfer-Encoding", F.when(marked, "chunked")), ("Content-Length", F.when(~marked, F.col("size")))),
        F.lit(_EOL), body)
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("response_id"), "application/http; msgtype=response", http,
        ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    request = _record(
        "request", F.col("request_id"), "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + _EOL + _EOL)),
        ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("response_id")))
    metadata = _record(
        "metadata", F.col("metadata_id"), "application/warc-fields",
        _headers(("page-id", F.col("page_id")), ("refers-to-page", F.col("refers_to"))),
        ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("request_id")))
    records = chosen.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # The fastest gzip level: markup still shrinks to about half, and the whole writer takes a third less CPU time.
    records.write.option("lineSep", _EOL).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files in ``path``: its headers, ids, payload (unchunked) and payload facts."""
    raw = spark.read.option("lineSep", _EOL + _START).text(path)
    # Cut by bytes, since a body need not be UTF-8. What is left of the version is one more head line.
    top = lambda text: F.substring_index(text, _EOL + _EOL, 1)
    rows = raw.filter(F.contains("value", F.lit(_EOL + _EOL))).select(
        top(F.col("value")).alias("top"), F.col("value").cast("binary").alias("bytes"))
    rows = rows.withColumn("head", F.concat(F.lit(_EOL), F.col("top"), F.lit(_EOL)))

    def header(name: str) -> Column:
        return let(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), lambda found: F.when(found != "", found))

    rows = rows.select(
        header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("record_id"),
        F.regexp_extract_all("head", F.lit(r"(?i)\r\nWARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1).alias("concurrent_to"),
        header("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(header("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("declared_digest"),
        header("Content-Length").cast("long").alias("length"), F.octet_length("top").alias("begin"), "bytes")
    rows = rows.withColumn("block", F.expr("substring(bytes, begin + 5, cast(length as int))")).withColumn(
        "truncated", F.octet_length("block") < F.col("length"))
    rows = rows.withColumn("block_top", top(F.col("block").cast("string")))
    rows = rows.withColumn("at", F.octet_length("block_top")).withColumn(
        "http_head", F.when(F.col("record_type").isin("response", "revisit"), F.concat("block_top", F.lit(_EOL))))
    chunked = F.col("http_head").rlike(r"(?i)\r\nTransfer-Encoding:[ \t]*chunked")
    body = F.when(F.col("record_type") == "response", F.expr("substring(block, at + 5)"))
    rows = rows.withColumn("payload", F.when(chunked, F.pandas_udf(_unchunk, "binary")(F.when(chunked, body))).otherwise(body))
    known = F.regexp_extract("http_head", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1)
    rows = rows.withColumns({
        "payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), F.when(known != "", known.cast("long"))),
        "payload_digest": F.coalesce(F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))), F.col("declared_digest")),
        "fields": F.when(F.col("record_type") == "metadata", F.col("block").cast("string"))})
    return rows.select("record_type", "record_id", "concurrent_to", "target_uri", "truncated", "fields", "payload_bytes",
                       "payload_digest", "declared_digest", *["payload"] * keep_payload)


def _unchunk(bodies: pd.Series) -> pd.Series:
    """The content of chunked bodies (null for null), chunk by chunk: size line, data, line end; what follows a size that is none is left."""
    def content(body: bytes) -> bytes:
        at, parts = 0, []
        while (end := body.find(b"\r\n", at)) >= 0:
            digits = body[at:end].split(b";")[0].strip()
            size = int(digits, 16) if digits and not digits.strip(b"0123456789abcdefABCDEF") else 0
            if size == 0:
                break
            parts.append(body[end + 2:end + 2 + size])
            at = end + 2 + size + 2
        return b"".join(parts)

    return bodies.map(content, na_action="ignore")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata, met through concurrent-to.

    A record without a response within two links makes no capture of its own; a response without others has nulls.
    """
    facts = records.select("record_id", "concurrent_to", F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("r"))
    mains = F.col("r.record_type").isin("response", "revisit")
    captures = facts.filter(mains).select(F.col("record_id").alias("capture"), "r")
    pairs = facts.select("record_id", mains.alias("main"), F.explode("concurrent_to").alias("other"))
    links = (
        pairs.select(F.col("record_id").alias("a"), F.col("other").alias("b"))
        .union(pairs.select(F.col("other"), F.col("record_id"))).distinct())
    parts = facts.filter(~mains)
    near = links.join(captures.select(F.col("capture").alias("b")), "b").select(F.col("a").alias("record_id"), F.col("b").alias("capture"))
    far = (
        parts.select(F.col("record_id").alias("a")).join(links, "a").select(F.col("a").alias("record_id"), F.col("b").alias("via"))
        .join(near.withColumnRenamed("record_id", "via"), "via").select("record_id", "capture"))
    found = (
        near.withColumn("hops", F.lit(1)).union(far.withColumn("hops", F.lit(2)))
        .groupBy("record_id").agg(F.min(F.struct("hops", "capture")).getField("capture").alias("capture")))
    placed = parts.join(found, "record_id").select("capture", "r")
    together = captures.union(placed).groupBy("capture").agg(
        F.first(F.when(F.col("r.record_type").isin("response", "revisit"), F.col("r")), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("r.record_type") == "request", F.col("r")), ignorenulls=True).alias("request"),
        F.array_sort(F.collect_list(F.when(~F.col("r.record_type").isin("response", "revisit", "request"), F.col("r")))).alias("metadata"))
    return together.withColumnRenamed("capture", "capture_id")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # The links meet the records several times: they are parsed once, and only headers and digests are kept.
    captures = assemble(stored(read_archives(spark, path, keep_payload=False), "warc-records"))
    fields = F.concat(F.lit("\r\n"), F.array_join(F.transform("metadata", lambda m: m["fields"]), ""))
    number = lambda name: F.regexp_extract(fields, rf"\r\n{name}: (-?\d+)\r\n", 1)
    as_long = lambda c: F.when(c != "", c.cast("long"))
    return captures.select(
        as_long(number("page-id")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        as_long(number("refers-to-page")).alias("refers_to"))


_BITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {15 - 5 * j}) & 31) + 1, 1)"
    for k in range(8) for j in range(4))

QUERIES = {"op1_warc_transactions": op1_warc_transactions}
ORACLES = {"op1_warc_transactions": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BITS} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""}
