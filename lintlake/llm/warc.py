"""WARC not-modified revisits: an as-of join to the latest earlier full response.

A capture is a row (record_id, url, ts, kind, status, headers, digest).  A revisit says that the server
answered ``304 Not Modified``; its content is that of the latest earlier full response (kind ``response``,
status 200) of the same canonical URL.  The revisit's validators are checked against that response and
the headers that a 304 may change are merged into the stored ones.

The as-of join is one ordered pass instead of a join of all pairs.  Captures are dealt by range over
(URL, time) into slices of even size, so no URL, however often captured, is one task; in a slice the last
full response is carried forward, and a URL that goes on in later slices hands over one row per slice.
Only URLs, times, validators and header maps travel, never payloads.

Defined cases: earlier means a smaller (ts, record_id); a null ts comes before all; a null or empty URL
has no earlier response, so its revisits are ``no_original``; null headers count as none; a revisit
without validators is ``unvalidated`` and still resolved; repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.operators.ordering import slices

#: Fields that a 304 must not change: they describe the stored payload or the connection.
KEPT = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
        "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that name no resource.
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|ref|sessionid|sid|phpsessid|jsessionid)"


def canonical(url: Column) -> Column:
    """Without scheme, user, default port, ``www.``, fragment, tracking parameters and closing slash; the
    host in lower case and the other parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^.*@", ""), r":(?:80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^{TRACKING}(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(value: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(value, r"^W/", "")


def _lower(headers: Column) -> Column:
    """Header names in lower case; of names that are then equal the last one counts."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    fields = F.transform(F.coalesce(F.map_entries(headers), none), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(fields, lambda e, i: ~F.exists(F.slice(fields, i + 2, F.size(fields) + 1), lambda f: f["key"] == e["key"])))


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers with those of the 304, but for the fields that it must not change."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT) & v.isNotNull())
    names = F.map_keys(allowed)
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(names, k)), allowed)


def carried(captures: DataFrame) -> DataFrame:
    """Each capture (with ``_key``, its canonical URL, and ``_full``, itself if a full response) and ``_original``,
    the latest earlier full response of its URL."""
    placed = slices(captures, [F.col("_key")], [F.col("ts"), F.col("record_id")])
    inside = Window.partitionBy("_group", "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("_full", ignorenulls=True).over(inside)
    # What the slices of a URL before this one hand over: one row per URL and slice, and only for
    # the URLs that lie in several.
    ends = placed.groupBy("_group", "_slice").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.col("_pos"))).alias("_end"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(earlier)).where(F.col("_far").isNotNull()).select("_group", "_slice", "_far")
    return (placed.withColumn("_near", near).join(handed, ["_group", "_slice"], "left")
            .withColumn("_original", F.when(F.coalesce(F.col("_key"), F.lit("")) != "", F.coalesce("_near", "_far")))
            .drop("_group", "_slice", "_pos", "_near", "_far"))


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, outcome, refers_to, payload_digest and headers (merged, only if
    resolved).

    Outcomes: ``resolved``, ``unvalidated`` (resolved without validators), ``mismatch`` (a validator or the payload
    digest differs from the stored one) and ``no_original``."""
    headers = _lower(F.col("headers"))
    narrow = captures.select("record_id", canonical(F.col("url")).alias("_key"), "ts", F.col("kind").alias("_kind"), F.col("status").alias("_status"),
                             "digest", headers.alias("headers"))
    full = (F.col("_kind") == "response") & (F.col("_status") == 200)
    marked = narrow.where(full | (F.col("_kind") == "revisit")).withColumn(
        "_full", F.when(full, F.struct("record_id", "digest", "headers")))
    found = carried(marked).where(F.col("_kind") == "revisit")
    was = F.col("_original")
    tag, old_tag = _tag(F.trim(F.col("headers")["etag"])), _tag(F.trim(was["headers"]["etag"]))
    date, old_date = F.trim(F.col("headers")["last-modified"]), F.trim(was["headers"]["last-modified"])
    # An entity tag decides alone; without one the modification date does.
    differs = (F.when(tag.isNotNull(), F.coalesce(tag != old_tag, F.lit(True)))
               .when(date.isNotNull(), F.coalesce(date != old_date, F.lit(True))).otherwise(False)
               | F.coalesce(F.col("digest") != was["digest"], F.lit(False)))
    outcome = (F.when(was.isNull(), "no_original").when(differs, "mismatch")
               .when(tag.isNull() & date.isNull(), "unvalidated").otherwise("resolved"))
    done = found.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unvalidated")
    return done.select("record_id", F.col("_key").alias("url_key"), "ts", "outcome", F.when(good, was["record_id"]).alias("refers_to"),
                       F.when(good, was["digest"]).alias("payload_digest"), F.when(good, merged(was["headers"], F.col("headers"))).alias("headers"))


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in the order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures that follow from the pages.  Page p is captured at time p + 1000 h, h = 0 .. 3, by its URL: first a
    response (a 404 for each eleventh page), then two revisits, and a response anew for each fifth page (else a
    revisit).  Entity tags come from the page's content; each seventh page has none, and each thirteenth neither
    tag nor date.  A second revisit has the tag of other content where p mod 6 is 0, and a weak tag where it is 1."""
    p = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    base = pages.select(p.alias("p"), F.col("url").cast("string").alias("url"), digest.alias("d"), F.length(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("size"))
    rows = base.withColumn("h", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))
    response = (F.col("h") == 0) | ((F.col("h") == 3) & (F.col("p") % 5 == 0))
    stated = F.when((F.col("h") == 2) & (F.col("p") % 6 == 0), F.reverse("d")).otherwise(F.col("d"))
    tag = F.when((F.col("p") % 7 != 0) & (F.col("p") % 13 != 0), F.concat(F.when((F.col("h") == 2) & (F.col("p") % 6 == 1), "W/").otherwise(""), F.lit('"'), stated, F.lit('"')))
    date = F.when(F.col("p") % 13 != 0, F.concat(F.lit("day "), (F.col("p") % 28).cast("string")))
    names = F.array(*[F.lit(x) for x in ("Content-Length", "ETag", "Last-Modified", "Cache-Control", "X-Served")])
    values = F.array(F.when(response, F.col("size").cast("string")).otherwise("0"), tag, date,
                     F.concat(F.lit("max-age="), (F.col("h") * 60).cast("string")), F.when(F.col("h") > 0, F.concat(F.lit("hop "), F.col("h").cast("string"))))
    return rows.select(
        (F.col("p") * 4 + F.col("h")).alias("record_id"), "url", (F.col("p") + 1000 * F.col("h")).alias("ts"),
        F.when(response, "response").otherwise("revisit").alias("kind"),
        F.when(response, F.when((F.col("h") == 0) & (F.col("p") % 11 == 0), 404).otherwise(200)).otherwise(304).alias("status"),
        F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull()).alias("headers"),
        F.when(response, F.col("d")).alias("digest"))


def report(pages: DataFrame) -> DataFrame:
    """The revisits of the captures that follow from the pages, with their merged headers as lines; texts that are
    missing are empty and a missing reference is -1."""
    return (resolve(captures_of(pages)).withColumn("headers", F.coalesce(header_lines(F.col("headers")), F.lit("")))
            .withColumn("refers_to", F.coalesce("refers_to", F.lit(-1))).withColumn("payload_digest", F.coalesce("payload_digest", F.lit("")))
            .withColumn("url_key", F.coalesce("url_key", F.lit(""))))


SQL = r"""
WITH base AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS d, length(coalesce(html, '')) AS size FROM pages),
rows AS (SELECT *, unnest([0, 1, 2, 3]) AS h FROM base),
bare AS (SELECT *, (h = 0 OR (h = 3 AND p % 5 = 0)) AS response,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rows),
captures AS (
  SELECT p * 4 + h AS record_id, p + 1000 * h AS ts, response, h, size, d,
         CASE WHEN response THEN CASE WHEN h = 0 AND p % 11 = 0 THEN 404 ELSE 200 END ELSE 304 END AS status,
         CASE WHEN p % 7 <> 0 AND p % 13 <> 0 THEN CASE WHEN h = 2 AND p % 6 = 1 THEN 'W/' ELSE '' END || '"' || CASE WHEN h = 2 AND p % 6 = 0 THEN reverse(d) ELSE d END || '"' END AS tag,
         CASE WHEN p % 13 <> 0 THEN 'day ' || CAST(p % 28 AS VARCHAR) END AS date,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^.*@', ''), ':(?:80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
              lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(?:utm_[a-z]+|fbclid|gclid|ref|sessionid|sid|phpsessid|jsessionid)(?:=|$)'))), '&'), ''), '') AS url_key
  FROM bare),
kept AS (SELECT * FROM captures WHERE NOT response OR status = 200),
placed AS (
  SELECT *, CASE WHEN url_key <> '' THEN last_value(CASE WHEN response THEN record_id END IGNORE NULLS)
         OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS was FROM kept),
joined AS (
  SELECT r.*, o.d AS old_d, o.size AS old_size, o.tag AS old_tag, o.date AS old_date, o.h AS old_h FROM placed r LEFT JOIN kept o ON o.record_id = r.was WHERE NOT r.response),
judged AS (
  SELECT *, CASE WHEN was IS NULL THEN 'no_original'
         WHEN CASE WHEN tag IS NOT NULL THEN coalesce(regexp_replace(tag, '^W/', '') <> regexp_replace(old_tag, '^W/', ''), true) WHEN date IS NOT NULL THEN coalesce(date <> old_date, true) ELSE false END THEN 'mismatch'
         WHEN tag IS NULL AND date IS NULL THEN 'unvalidated' ELSE 'resolved' END AS outcome FROM joined)
SELECT record_id, coalesce(url_key, '') AS url_key, ts, outcome, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN was ELSE -1 END AS refers_to,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN old_d ELSE '' END AS payload_digest,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
         'cache-control: max-age=' || CAST(h * 60 AS VARCHAR) || chr(10) || 'content-length: ' || CAST(old_size AS VARCHAR)
         || coalesce(chr(10) || 'etag: ' || coalesce(tag, old_tag), '') || coalesce(chr(10) || 'last-modified: ' || coalesce(date, old_date), '')
         || chr(10) || 'x-served: hop ' || CAST(h AS VARCHAR) ELSE '' END AS headers
FROM judged
"""
