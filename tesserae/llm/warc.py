"""Resolution of WARC revisit records: which earlier response a not-modified answer stands for.

An as-of join: each revisit takes the latest full response (status 200) of its canonical URL with an earlier date. It is then held against
the validators: entity tags (weakly), else the date of last modification, else the payload digest. A resolved revisit gets the response's
headers, with those of its own that a 304 answer may update.

Distribution: the join is two passes of windows over metadata; payloads stay where they are and are named by record. Time is cut into
spans. The last response of each (URL, span) is an aggregation with partial sums; carried over a URL's spans it enters each span as its
first row; the window that finds the latest response then works within a (URL, span). A URL with a third of all records is so dealt over
its spans.

Edge cases: a null or empty URL matches nothing (``no_url``); a null date is earlier than any; among responses of one date the greatest
record id counts; repeated revisits give a row each; no validator on either side is ``unverified`` and still names the response; null
header maps are empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Header fields that a 304 answer may bring up to date.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and closing slash or index page; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://(www\\.)?", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substr(bare, F.length(host) + 1)
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?"), "[?&]+$", "")
    rest = F.regexp_replace(rest, "^([^?]*?)(/index\\.html?|/+)([?]|$)", "$1$3")
    return F.nullif(F.concat(F.regexp_replace(F.lower(host), ":(80|443)$", ""), rest), F.lit(""))


def _lowered(headers: Column) -> Column:
    """Header map with names in lower case; of names that fall together the last in order of spelling stays."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.array_sort(F.map_entries(F.coalesce(headers, empty)))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    unique = F.array_distinct(names)
    return F.map_from_arrays(unique, F.transform(unique, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """One row for each revisit.

    records: record_id long, url string, date long (seconds), kind string (``response`` or ``revisit``), status int, etag string,
    last_modified long, payload_digest string, headers map<string,string>. Returned: record_id, canonical_url, response_id, outcome
    (``resolved``, ``validator_mismatch``, ``unverified``, ``no_earlier_response``, ``no_url``), payload_digest (of the response, where
    resolved or unverified), headers (merged likewise; the revisit's own otherwise).
    """
    url = canonical_url(F.col("url"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id",
        F.coalesce(F.col("date"), F.lit(-(1 << 62)).cast("long")).alias("date"),
        (F.col("kind") == "response").alias("is_response"),
        url.alias("canonical_url"),
        F.coalesce(url, F.concat(F.lit("?"), F.col("record_id").cast("string"), F.col("kind"))).alias("key"),
        F.struct(F.coalesce(F.col("date"), F.lit(-(1 << 62)).cast("long")).alias("date"), "record_id", "etag", "last_modified", "payload_digest", _lowered(F.col("headers")).alias("headers")).alias("own"),
    )
    rows = rows.withColumn("span", F.floor(F.col("date") / span_seconds))
    entry = F.struct("own.date", "own.record_id", "own.etag", "own.last_modified", "own.payload_digest", F.map_entries("own.headers").alias("headers"))
    last = rows.groupBy("key", "span").agg(F.max(F.when(F.col("is_response"), entry)).alias("last"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "span", F.last("last", ignorenulls=True).over(before).alias("hit")).where("hit is not null")
    plain = rows.select("key", "span", "date", "is_response", "canonical_url", "own", F.when(F.col("is_response"), entry).alias("hit"))
    first = carried.select("key", "span", F.lit(-(1 << 63)).cast("long").alias("date"), F.lit(True).alias("is_response"), F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), "hit")
    # A revisit comes before the responses of its own date, so those are not earlier ones.
    upto = Window.partitionBy("key", "span").orderBy("date", "is_response", "hit.record_id").rowsBetween(Window.unboundedPreceding, 0)
    found = plain.unionByName(first).withColumn("hit", F.last("hit", ignorenulls=True).over(upto)).where(~F.col("is_response"))
    own, hit = F.col("own"), F.col("hit")
    validator = (
        F.when(own["etag"].isNotNull() & hit["etag"].isNotNull(), _weak(own["etag"]) == _weak(hit["etag"]))
        .when(own["last_modified"].isNotNull() & hit["last_modified"].isNotNull(), own["last_modified"] == hit["last_modified"])
        .when(own["payload_digest"].isNotNull() & hit["payload_digest"].isNotNull(), own["payload_digest"] == hit["payload_digest"])
    )
    outcome = F.when(F.col("canonical_url").isNull(), "no_url").when(hit.isNull(), "no_earlier_response").when(validator.isNull(), "unverified").when(validator, "resolved").otherwise("validator_mismatch")
    new = F.map_filter(own["headers"], lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(F.map_from_entries(hit["headers"]), lambda k, v: ~F.map_contains_key(new, k))
    stands = F.col("outcome").isin("resolved", "unverified")
    return found.withColumn("outcome", outcome).select(
        own["record_id"].alias("record_id"),
        "canonical_url",
        F.when(F.col("outcome") != "no_url", hit["record_id"]).alias("response_id"),
        "outcome",
        F.when(stands, hit["payload_digest"]).alias("payload_digest"),
        F.when(stands, F.map_concat(old, new)).otherwise(own["headers"]).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Records made of pages (page_id, url, html): page p is fetched a minute after page p - 1, and asked for again 1,000,000 s later.

    The answer then says that the page is as it was. Where the page has an entity tag it names that, else (pages whose length is a multiple
    of 5) when the page was last modified. Another fetch of the same canonical URL in between makes the answer stand for that one, and
    its validators differ.
    """
    base = pages.select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("string").alias("size"), (F.col("page_id") * 60).alias("at"), (F.length("html") % 5 != 0).alias("tagged"))
    tag, text = F.when(F.col("tagged"), F.concat(F.lit('"'), F.substr("digest", F.lit(1), F.lit(16)), F.lit('"'))), lambda c: F.col(c).cast("string")

    def record(shift: int, kind: str, headers: list[Column]) -> Column:
        return F.struct(
            (F.col("page_id") * 2 + int(kind == "revisit")).alias("record_id"),
            (F.col("at") + shift).alias("date"),
            F.lit(kind).alias("kind"),
            F.lit(200 if kind == "response" else 304).alias("status"),
            (tag if kind == "response" else F.concat(F.lit("W/"), tag)).alias("etag"),
            F.col("at").alias("last_modified"),
            F.when(F.lit(kind == "response"), F.col("digest")).alias("payload_digest"),
            F.create_map(*headers).alias("headers"),
        )

    response = record(0, "response", [F.lit("Content-Length"), F.col("size"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text("at"), F.lit("Cache-Control"), F.lit("max-age=60")])
    revisit = record(1_000_000, "revisit", [F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (F.col("at") + 1_000_000).cast("string"), F.lit("Expires"), (F.col("at") + 1_000_600).cast("string")])
    return base.select("url", F.explode(F.array(response, revisit)).alias("r")).select("url", "r.*")


def digest(resolved: DataFrame) -> DataFrame:
    """The merged headers as one line, in order of name."""
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return resolved.select("record_id", "canonical_url", "response_id", "outcome", "payload_digest", line.alias("headers"))
