"""Resolution of not-modified revisits in web archives.

Records are parsed from their WARC text. A revisit of a 304 answer has no content of its own: it is resolved to the
latest full response before it under the same canonical URL, if the validators (ETag, compared weakly, else
Last-Modified) agree, and the headers that a 304 may update replace those of the response.

The as-of join takes no side into memory: captures are put into ranges of (URL, time), so a URL with a third of all
captures spans as many ranges as it needs. Within a range a window carries the latest response on; between ranges
only the last response of each URL is carried, one small row. Payloads are not shuffled, only their digests.

Records without a target or a date cannot be placed and are left out of responses; such revisits get the status
``orphan``. Of responses at the same time the one with the greater record id counts; a response at the very time of a
revisit is not before it. Repeated records give repeated results. Null records are ignored, as are other columns.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.scratch import written

# Header fields that an answer 304 must not change (RFC 9110, 9111), and those that end at one hop.
NOT_UPDATED = (
    "connection content-encoding content-length content-location content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()

_BREAK = "\r\n"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without a last slash, sorted parameters; no scheme, user or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.regexp_extract(bare, r"\?(.*)$", 1)
    parameters = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: p != "")), "&")
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(parameters == "", F.lit("")).otherwise(F.concat(F.lit("?"), parameters)))


def _headers(head: Column) -> Column:
    """The header lines after the first as array of (name in lower case, value)."""
    lines = F.filter(F.slice(F.split(head, _BREAK), 2, 1_000_000), lambda line: F.instr(line, ":") > 1)
    return F.transform(
        lines,
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
            F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        ),
    )


def _value(headers: Column, name: str) -> Column:
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def parse(records: DataFrame, column: str = "record") -> DataFrame:
    """kind, record_id, url, url_key, captured, status, headers, payload_chars, payload_md5 of each WARC record."""
    parts = F.split(F.col(column), _BREAK * 2, 3)
    split = records.where(F.col(column).isNotNull()).select(parts.alias("parts")).select(
        _headers(F.col("parts")[0]).alias("warc"), F.get("parts", F.lit(1)).alias("http"),
        F.coalesce(F.get("parts", F.lit(2)), F.lit("")).alias("payload"),
    )
    url = F.regexp_replace(_value(F.col("warc"), "warc-target-uri"), "^<|>$", "")
    return split.select(
        F.lower(_value(F.col("warc"), "warc-type")).alias("kind"), _value(F.col("warc"), "warc-record-id").alias("record_id"),
        url.alias("url"), canonical_url(url).alias("url_key"),
        F.to_timestamp(_value(F.col("warc"), "warc-date")).alias("captured"),
        F.regexp_extract(F.coalesce("http", F.lit("")), r"^HTTP/\S+ (\d{3})", 1).alias("status"),
        F.coalesce(_headers(F.col("http")), F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
        F.length("payload").cast("bigint").alias("payload_chars"), F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


def _etag(headers: Column) -> Column:
    return F.regexp_replace(_value(headers, "etag"), "^W/", "")


def merged_headers(base: Column, update: Column) -> Column:
    """``base`` with the fields that ``update`` may change replaced by those of ``update``."""
    allowed = F.filter(update, lambda h: ~h["name"].isin(NOT_UPDATED))
    names = F.transform(allowed, lambda h: h["name"])
    return F.concat(F.filter(base, lambda h: ~F.array_contains(names, h["name"])), allowed)


_FULL = ["record_id", "captured", "headers", "payload_chars", "payload_md5"]


def _as_of(captures: DataFrame) -> DataFrame:
    """``captures`` (url_key, captured, full, ...) that are not full, with the latest full one before each as ``earlier``."""
    order = ["url_key", "captured", "full", "record_id"]
    placed = written(
        captures.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "captures"
    )
    response = F.when(F.col("full"), F.struct(*_FULL))
    inside = Window.partitionBy("part", "url_key").orderBy("captured", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("inside", F.last(response, ignorenulls=True).over(inside)).where("NOT full")
    ranges = placed.groupBy("url_key", "part").agg(F.max(F.when(F.col("full"), F.struct("captured", "record_id", *_FULL[2:]))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried IS NOT NULL").select(
        F.col("url_key").alias("of"), F.col("part").alias("at"), F.struct(*[F.col("carried")[c].alias(c) for c in _FULL]).alias("carried")
    )
    joined = seen.join(carried, (F.col("url_key") == F.col("of")) & (F.col("part") == F.col("at")), "left")
    return joined.withColumn("earlier", F.coalesce("inside", "carried")).drop("inside", "carried", "of", "at", "part", "full")


def resolve(records: DataFrame, column: str = "record") -> DataFrame:
    """One row per revisit: revisit_id, url_key, captured, resolution, response_id, response_time, headers, payload_chars, payload_md5.

    ``resolution``: resolved; unchecked (no validator in common); changed (a validator differs); orphan (no response
    before it). Headers and payload are given for resolved and unchecked revisits.
    """
    parsed = parse(records, column)
    full = (F.col("kind") == "response") & (F.col("status") == "200")
    # Written once, without payloads: the ranges of the join are found from it and dealt from it.
    kept = written(parsed.where(full | (F.col("kind") == "revisit")).select("url_key", full.alias("full"), *_FULL), "records")
    placed = kept.where("url_key IS NOT NULL AND captured IS NOT NULL")
    lost = kept.where("NOT full AND (url_key IS NULL OR captured IS NULL)").drop("full")
    found = _as_of(placed)
    found = found.unionByName(lost.withColumn("earlier", F.lit(None).cast(found.schema["earlier"].dataType)))
    ours, theirs = F.col("headers"), F.col("earlier")["headers"]
    by_tag, by_date = _etag(ours) == _etag(theirs), _value(ours, "last-modified") == _value(theirs, "last-modified")
    same = F.coalesce(by_tag, by_date)
    resolution = (
        F.when(F.col("earlier").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    )
    usable = F.col("resolution").isin("resolved", "unchecked")
    shown = F.array_join(F.transform(merged_headers(theirs, ours), lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return found.withColumn("resolution", resolution).select(
        F.col("record_id").alias("revisit_id"), "url_key", F.date_format("captured", stamp).alias("captured"), "resolution",
        F.when(usable | (F.col("resolution") == "changed"), F.col("earlier")["record_id"]).alias("response_id"),
        F.date_format(F.col("earlier")["captured"], stamp).alias("response_time"),
        F.when(usable, shown).alias("headers"), F.when(usable, F.col("earlier")["payload_chars"]).alias("payload_chars"),
        F.when(usable, F.col("earlier")["payload_md5"]).alias("payload_md5"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """WARC records (one text each) of a table of pages: the capture of each page, and a later 304 answer for its URL.

    Capture times follow page_id. The second request goes to the URL with a fragment; its answer carries the page's ETag
    or, for every fifth page, another one, and every seventh page was asked for before it was first captured.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.md5(body.cast("binary"))
    number = F.col("page_id").cast("string")
    first = F.lit(1_704_067_200) + F.col("page_id") * 60

    def stamp(seconds: Column) -> Column:
        return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def lines(*parts: Column | str) -> Column:
        return F.concat_ws(_BREAK, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    response = lines(
        "WARC/1.1", "WARC-Type: response", field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        field("WARC-Target-URI", F.col("url")), field("WARC-Date", stamp(first)), "Content-Type: application/http;msgtype=response", "",
        "HTTP/1.1 200 OK", field("Date", stamp(first)), field("ETag", F.concat(F.lit('"'), tag, F.lit('"'))),
        "Content-Type: text/html; charset=utf-8", "Cache-Control: max-age=60", field("Content-Length", F.octet_length(body).cast("string")),
        "", body,
    )
    again = first + F.when(F.col("page_id") % 7 == 0, F.lit(-30)).otherwise(F.lit(30))
    shown = F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(tag)
    revisit = lines(
        "WARC/1.1", "WARC-Type: revisit", field("WARC-Record-ID", F.concat(F.lit("<urn:again:"), number, F.lit(">"))),
        field("WARC-Target-URI", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))), field("WARC-Date", stamp(again)),
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified", "", "HTTP/1.1 304 Not Modified",
        field("Date", stamp(again)), field("ETag", F.concat(F.lit('W/"'), shown, F.lit('"'))), "Cache-Control: max-age=600",
        "Content-Length: 0", "Connection: close", "", "",
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("record"))
