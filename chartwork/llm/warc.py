"""Web archive captures: revisits that were not modified, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwork.llm.common import small

# Query parameters that don't name a resource
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
# Header fields of a 304 response that never replace those of the stored response
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
#: Pieces that a URL's captures are cut into by time, and captures from which a URL is cut.
CHUNKS, PIECE_ROWS = 256, 10_000
#: Rows of CHUNKS bounds that are broadcast, about 20 MB.
BOUNDS = 10_000


def canonical_url(url: str = "url") -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a last slash left out; host in lower case, parameters sorted."""
    u = F.regexp_replace(F.trim(F.col(url)), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def etag_core(tag: Column) -> Column:
    """An entity tag without the mark of a weak one: revisits compare weakly."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def cut_by_time(rows: DataFrame, chunks: int = CHUNKS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with ``_chunk``: for a URL of more than ``piece_rows`` captures, one of ``chunks`` pieces of its times, about equally full.

    The bounds are quantiles of the URL's own times, so that captures that lie close together in time are cut too.
    Captures of one time stay together; those without a time are piece -1; other URLs are one piece, 0.
    """
    chunk = F.lit(0)
    if chunks > 1:
        crowded = rows.where("canonical is not null").groupBy("canonical").count().where(F.col("count") > piece_rows).select("canonical")
        quantiles = F.percentile_approx("_t", [i / chunks for i in range(1, chunks)]).alias("_bounds")
        bounds = rows.join(small(crowded, BOUNDS), "canonical", "left_semi").groupBy("canonical").agg(quantiles)
        rows = rows.join(small(bounds, BOUNDS), "canonical", "left")
        chunk = F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b <= F.col("_t"))))
    cut = rows.withColumn("_chunk", F.when(F.col("_t").isNull(), -1).otherwise(chunk))
    return cut.drop("_bounds")


def resolve_revisits(captures: DataFrame, chunks: int = CHUNKS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Each 304 revisit with the latest earlier full response of its canonical URL.

    ``captures`` has record_id long, url string, ts timestamp or long, status int, headers map<string,string> (names
    in lower case). Columns returned: revisit_id, canonical, revisit_ts, target_id, target_ts, outcome and headers.
    A full response has status 200. At equal times, lower record_ids are earlier. The outcome is

    - ``resolved``: a validator agrees (etag weakly; last-modified if either side has no etag),
    - ``mismatch``: the validators that both sides have disagree,
    - ``unchecked``: they have no validator in common,
    - ``orphan``: there is no earlier full response; target and headers are null.

    Headers are those of the target with the fields that a 304 may change taken from the revisit, but for mismatches,
    which keep the target's. A null url is canonical to nothing: an orphan. Null headers count as none. Repeated
    records give repeated rows; records with a null ts come first.

    A URL's captures are cut into pieces by ``cut_by_time``; each piece is scanned in order by itself, and starts with the last full response of the pieces before it. Bodies don't travel: join them by target_id.
    """
    ts = F.col("ts").cast("timestamp").cast("double") if dict(captures.dtypes)["ts"].startswith("timestamp") else F.col("ts").cast("double")
    rows = captures.select("record_id", canonical_url().alias("canonical"), "ts", ts.alias("_t"), "status", F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"))
    rows = rows.where("status in (200, 304)")
    full = F.when(F.col("status") == 200, F.struct(F.col("_t").alias("t"), F.col("record_id").alias("id"), "ts", "headers"))
    marked = cut_by_time(rows, chunks, piece_rows).withColumn("_full", full)
    # the last full response of each piece; pieces a URL are at most ``chunks`` + 1
    order = F.struct(F.coalesce(F.col("_full.t"), F.lit(float("-inf"))), F.col("_full.id"))
    lasts = marked.where("status = 200 and canonical is not null").groupBy("canonical", "_chunk").agg(F.max_by("_full", order).alias("_last"))
    before = Window.partitionBy("canonical").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    span = marked.where("canonical is not null").select("canonical", "_chunk").distinct().join(lasts, ["canonical", "_chunk"], "left")
    carried = span.select("canonical", "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy("canonical", "_chunk").orderBy(F.col("_t").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    known = marked.where("canonical is not null").withColumn("_near", F.last("_full", ignorenulls=True).over(inside)).where("status = 304")
    found = known.join(carried, ["canonical", "_chunk"], "left").withColumn("_target", F.coalesce("_near", "_carry"))
    lost = marked.where("canonical is null and status = 304").withColumn("_near", F.lit(None).cast(marked.schema["_full"].dataType)).withColumn("_carry", F.col("_near")).withColumn("_target", F.col("_near"))
    found = found.unionByName(lost)
    own, kept = F.col("headers"), F.col("_target.headers")
    tags = (etag_core(own["etag"]), etag_core(kept["etag"]))
    dates = (own["last-modified"], kept["last-modified"])
    both_tags, both_dates = tags[0].isNotNull() & tags[1].isNotNull(), dates[0].isNotNull() & dates[1].isNotNull()
    outcome = (
        F.when(F.col("_target.id").isNull(), "orphan")
        .when(both_tags, F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(both_dates, F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    changes = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(*KEPT_FIELDS))
    merged = F.map_concat(F.map_filter("_target.headers", lambda k, v: ~F.map_contains_key(F.col("_changes"), k)), F.col("_changes"))
    out = found.withColumn("outcome", outcome).withColumn("_changes", changes)
    headers = F.when(F.col("outcome") == "orphan", None).when(F.col("outcome") == "mismatch", F.col("_target.headers")).otherwise(merged)
    return out.select(F.col("record_id").alias("revisit_id"), "canonical", F.col("ts").alias("revisit_ts"), F.col("_target.id").alias("target_id"), F.col("_target.ts").alias("target_ts"), "outcome", headers.alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: every page once as a full response and once, later, as a revisit.

    Records: 2 * page_id at second 2 * page_id, and 2 * page_id + 1 five seconds later. Validators are digests of the
    html; each third page is revisited with a weak tag, each seventh with a stale one, and each fifth has a date only.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.substring(F.md5(F.coalesce("html", F.lit(""))), 17, 4))
    p = F.col("page_id")

    def fields(*pairs: tuple[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())

    only_date = p % 5 == 0
    first = fields(("content-type", F.lit("text/html")), ("content-length", F.octet_length("html").cast("string")), ("date", F.concat(F.lit("second "), (2 * p).cast("string"))), ("etag", F.when(~only_date, tag)), ("last-modified", day), ("cache-control", F.lit("max-age=60")))
    again = fields(("date", F.concat(F.lit("second "), (2 * p + 5).cast("string"))), ("content-length", F.lit("0")), ("cache-control", F.lit("max-age=600")), ("etag", F.when(~only_date, F.when(p % 7 == 0, F.lit('"stale"')).when(p % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag))), ("last-modified", day))
    one = pages.select((2 * p).alias("record_id"), "url", (2 * p).alias("ts"), F.lit(200).alias("status"), first.alias("headers"))
    two = pages.select((2 * p + 1).alias("record_id"), "url", (2 * p + 5).alias("ts"), F.lit(304).alias("status"), again.alias("headers"))
    return one.unionByName(two)
