r"""Operator 9: linked metadata and plain-text conversion records from WARC responses.

Each response gives two records. The metadata record (application/warc-fields) keeps the source's
status, all source headers in order, its block and payload digests, the title and the outgoing links.
The conversion record (text/plain) holds the page's text. Both refer to the response by its
identifier, name each other with WARC-Concurrent-To, and carry digests of their own blocks.
Identifiers are made from the source's identifier, so a rerun gives the same records.

Everything is a projection: no shuffle, no state, work in proportion to the bytes: a comment, script,
style or title that is never closed ends with the page, as in a browser, and a tag never reaches over
the next < sign, so no expression scans the rest of a page again and again. A record is text;
`write_records` puts them, with the two line ends that close a record, into gzip files.

Edge cases: a < that opens no tag stays text; a numeric character reference that names no character
stays as it is; a null or empty body gives an empty text with the digests of no bytes; a response without
a blank line is all head; a null identifier, address or date is an empty string; repeated rows give
repeated records; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
# fixed values: HTML's named character references that are resolved, & last
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[ \t\n\r\f]*>|\z)|<style\b.*?(?:</style[ \t\n\r\f]*>|\z)|<title\b.*?(?:</title[ \t\n\r\f]*>|\z)"
_BLOCK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|pre|blockquote|nav|header|footer|article|section|aside|main|form|body|html)\b[^<>]*>"
_TAG = r"</?[A-Za-z!?][^<>]*>"
_LINK = r"""(?i)<a\b[^<>]*\bhref[ \t\n\r\f]*=[ \t\n\r\f]*("[^"<>]*"|'[^'<>]*')"""
_TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title|\z)"
_NUMBER = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def identifier(kind: str, source: Column) -> Column:
    """A urn:uuid from the first 128 bits of a digest of kind and source."""
    h = F.sha2(F.concat(F.lit(f"{kind} "), source).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages (page_id, url, html) as responses: record_id, target_uri, date, block."""
    key = F.concat(_text(F.col("page_id").cast("string")), F.lit(" "), _text("url"))
    body = _text("html")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(identifier("response", key).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"))


def _character(reference: Column) -> Column:
    """The character that &#65; or &#x41; names; the reference itself where there is none."""
    digits = F.substring(reference, F.lit(3), F.length(reference) - 3)
    code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).cast("int")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(reference)


def _once(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescaped(c: Column) -> Column:
    """Numeric references first, then named ones, & last; each reference is resolved once."""
    cut = F.lit(rf"(?s)(.*?)({_NUMBER}|\z)")
    parts = lambda x: F.zip_with(F.regexp_extract_all(x, cut, F.lit(1)), F.regexp_extract_all(x, cut, F.lit(2)), lambda g, r: F.concat(g, F.when(r == "", "").otherwise(_character(r))))
    c = _once(c, lambda x: F.when(x.rlike(_NUMBER), F.array_join(parts(x), "")).otherwise(x))
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_text(html: Column) -> Column:
    """The text of a page: unseen parts dropped, blocks on lines of their own, white space squeezed."""
    c = F.regexp_replace(html, _UNSEEN, " ")
    c = F.regexp_replace(F.regexp_replace(c, _BLOCK, "\n"), _TAG, "")
    c = F.regexp_replace(unescaped(c), r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+\z", "")


def derivatives(sources: DataFrame) -> DataFrame:
    """warc_type, record_id, refers_to, target_uri, content_length, block_digest, source_payload_digest, record."""
    cut = F.locate(CRLF + CRLF, F.col("block"))
    d = sources.select(_text("record_id").alias("source"), _text("target_uri").alias("target_uri"), _text("date").alias("date"), _text("block").alias("block"))
    head = F.when(cut > 0, F.expr("substring(block, 1, locate('\r\n\r\n', block) - 1)")).otherwise(F.col("block"))
    body = F.when(cut > 0, F.expr("substring(block, locate('\r\n\r\n', block) + 4)")).otherwise(F.lit(""))
    d = d.select("source", "target_uri", "date", digest(F.col("block")).alias("source_block_digest"), head.alias("head"), body.alias("body"))
    d = d.withColumn("source_payload_digest", digest(F.col("body")))
    lines = F.split("head", CRLF)
    fields = F.concat(
        F.lit("source-status: "),
        F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1),
        F.lit(f"{CRLF}source-block-digest: "),
        F.col("source_block_digest"),
        F.lit(f"{CRLF}source-payload-digest: "),
        F.col("source_payload_digest"),
        F.lit(CRLF),
        F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("source-header: "), x, F.lit(CRLF))), ""),
        F.lit("title: "),
        F.trim(F.regexp_replace(unescaped(F.regexp_extract("body", _TITLE, 1)), r"[ \t\r\n\f\x0B]+", " ")),
        F.lit(CRLF),
        F.array_join(F.transform(F.regexp_extract_all("body", F.lit(_LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), unescaped(F.substring(x, F.lit(2), F.length(x) - 2)), F.lit(CRLF))), ""),
    )
    meta, conv = identifier("metadata", F.col("source")), identifier("conversion", F.col("source"))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), meta.alias("record_id"), conv.alias("beside"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), conv.alias("record_id"), meta.alias("beside"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("body")).alias("block")),
    )
    d = d.select("source", "target_uri", "date", "source_payload_digest", F.inline(made))
    d = d.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block")))
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "source"), ("WARC-Concurrent-To", "beside"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    record = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit(CRLF)) for n, c in named], F.lit(CRLF), F.col("block"))
    return d.select("warc_type", "record_id", F.col("source").alias("refers_to"), "target_uri", "content_length", "block_digest", "source_payload_digest", record.alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition."""
    records.select("record").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


ORACLE = r"""
WITH p AS (
    SELECT coalesce(url, '') AS target_uri, coalesce(html, '') AS body, sha256('response ' || coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')) AS h FROM pages
), r AS (
    SELECT target_uri, body,
        '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS source,
        'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) AS head
    FROM p
), s AS (
    SELECT *, chr(13) || chr(10) AS e, sha256('metadata ' || source) AS m, sha256('conversion ' || source) AS c,
        'sha256:' || sha256(body) AS payload, 'sha256:' || sha256(head || chr(13) || chr(10) || chr(13) || chr(10) || body) AS whole,
        list_concat([
            regexp_replace(regexp_replace(regexp_replace(body,
                '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[ \t\n\r\f]*>|\z)|<style\b.*?(?:</style[ \t\n\r\f]*>|\z)|<title\b.*?(?:</title[ \t\n\r\f]*>|\z)', ' ', 'g'),
                '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|pre|blockquote|nav|header|footer|article|section|aside|main|form|body|html)\b[^<>]*>', chr(10), 'g'),
                '</?[A-Za-z!?][^<>]*>', '', 'g'),
            regexp_extract(body, '(?is)<title\b[^<>]*>(.*?)(?:</title|\z)', 1)],
            list_transform(regexp_extract_all(body, '(?i)<a\b[^<>]*\bhref[ \t\n\r\f]*=[ \t\n\r\f]*("[^"<>]*"|''[^''<>]*'')', 1), lambda x: x[2:-2])) AS raw
    FROM r
), n AS (
    SELECT *, list_transform(raw, lambda x: CASE WHEN NOT regexp_matches(x, '&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});') THEN x ELSE array_to_string(list_transform(
        list_zip(regexp_extract_all(x, '(?s)(.*?)(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|\z)', 1), regexp_extract_all(x, '(?s)(.*?)(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|\z)', 2)),
        lambda z: z[1] || CASE WHEN z[2] = '' THEN '' ELSE coalesce(list_transform([try_cast(replace(lower(z[2][3:-2]), 'x', '0x') AS INTEGER)],
            lambda k: CASE WHEN k BETWEEN 1 AND 55295 OR k BETWEEN 57344 AND 1114111 THEN chr(k) END)[1], z[2]) END), '') END) AS numbered
    FROM s
), v AS (
    SELECT *, list_transform(numbered, lambda x: replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')) AS clear
    FROM n
), u AS (
    SELECT *,
        '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' AS m_id,
        '<urn:uuid:' || c[1:8] || '-' || c[9:12] || '-' || c[13:16] || '-' || c[17:20] || '-' || c[21:32] || '>' AS c_id,
        regexp_replace(regexp_replace(regexp_replace(clear[1], '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g') AS plain,
        'source-status: 200' || e || 'source-block-digest: ' || whole || e || 'source-payload-digest: ' || payload || e
            || 'source-header: Content-Type: text/html; charset=utf-8' || e || 'source-header: Content-Length: ' || strlen(body) || e
            || 'title: ' || trim(regexp_replace(clear[2], '[ \t\r\n\f\x0B]+', ' ', 'g')) || e
            || array_to_string(list_transform(clear[3:], lambda x: 'outlink: ' || x || e), '') AS fields
    FROM v
), b AS (
    SELECT 'metadata' AS warc_type, m_id AS record_id, c_id AS beside, source, target_uri, payload, 'application/warc-fields' AS content_type, fields AS block, e FROM u
    UNION ALL
    SELECT 'conversion', c_id, m_id, source, target_uri, payload, 'text/plain; charset=utf-8', plain, e FROM u
)
SELECT warc_type, record_id, source AS refers_to, target_uri, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload AS source_payload_digest,
    sha256('WARC/1.1' || e || 'WARC-Type: ' || warc_type || e || 'WARC-Record-ID: ' || record_id || e || 'WARC-Refers-To: ' || source || e || 'WARC-Concurrent-To: ' || beside || e
        || 'WARC-Target-URI: ' || target_uri || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Block-Digest: sha256:' || sha256(block) || e || 'WARC-Source-Payload-Digest: ' || payload || e
        || 'Content-Type: ' || content_type || e || 'Content-Length: ' || strlen(block) || e || e || block) AS record_sha256
FROM b
"""
