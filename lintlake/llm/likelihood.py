"""Quality rules with a log-likelihood ratio of hashed n-grams, on DataFrame functions alone.

Words and pairs of neighbouring words are hashed (CRC-32) into ``BUCKETS``.  The trusted target, the documents
that labels call good and none calls toxic, and the raw corpus, all documents, each give a multinomial over the
buckets, smoothed by one.  The gain of a bucket is ln(p_target / p_raw) in whole millionths; the sum of a
document's gains over its number of n-grams is its score.  A document is kept if it fails no base rule and its
score is ``THRESHOLD`` or more; whole numbers make the verdict the same on every run and cluster.

Base rules: fewer than ``LEAST_WORDS`` words, or more than half of the words in three-word windows that occur
twice or more in the text.

Counts are reduced map-side to at most ``BUCKETS`` rows a task, over all documents; the table of gains has at
most ``BUCKETS`` rows, so it is broadcast.  A document's n-grams are rows of one task each, summed where they
are made, so what is shuffled is one row per document, and a text of any length or a word of any frequency
neither fills a row nor a task.  Only the texts of trusted documents, and few others, meet their labels by a join
on the id: the others are left out by bitmaps of hashed ids, whose size is fixed.

Defined cases: null and empty texts have no words, count as zero and fail; null ids have no label; an id with
several labels is trusted if all are good; without a trusted word all gains are zero and the base rules alone
decide; rows that occur several times are counted and returned several times; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm.common import crc32_sql, text_of
from lintlake.operators.marks import only_marked
from lintlake.session import cut

BUCKETS = 1 << 14
THRESHOLD = -100_000  # millionths of a nat per n-gram
LEAST_WORDS = 50
IDS = 1 << 25  # bits for hashed ids of trusted documents: 4 MB
WINDOW = 3
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _pairs(array: str) -> Column:
    """An array of (word, next word); the last word has no next one."""
    return F.arrays_zip(F.col(array).alias("w"), F.slice(array, 2, F.greatest(F.size(array), F.lit(1))).alias("v"))


def _bucket(*parts: Column) -> Column:
    return (F.crc32(F.concat_ws(" ", *parts).cast("binary")) % BUCKETS).cast("int")


def counted(texts: DataFrame, name: str) -> DataFrame:
    """bucket and its number of n-grams in a table with ``text``."""
    pairs = texts.select(words(text_of()).alias("_w")).select(F.explode(_pairs("_w")).alias("_p")).select("_p.*")
    both = F.when(F.col("v").isNull(), F.array(_bucket(F.col("w")))).otherwise(F.array(_bucket(F.col("w")), _bucket(F.col("w"), F.col("v"))))
    return pairs.select(F.explode(both).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain (long, millionths) of every bucket of the raw texts; at most ``BUCKETS`` rows."""
    made = cut(counted(raw, "s").join(counted(target, "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")))
    # Words of the target are counted whether or not the raw texts have them; here the target is part of the raw texts.
    s, t = made.agg(F.sum("s"), F.sum("t")).first()
    if not t:
        return made.select("bucket", F.lit(0).cast("long").alias("gain"))
    ratio = (F.col("t") + 1).cast("double") * float(s + BUCKETS) / ((F.col("s") + 1).cast("double") * float(t + BUCKETS))
    return made.select("bucket", F.floor(F.log(ratio) * 1e6).cast("long").alias("gain"))


def _repeated(array: str) -> Column:
    """Number of words in windows that occur more than once: windows are sorted, so equal ones are neighbours."""
    windows = F.arrays_zip(F.transform(F.arrays_zip(*[F.slice(array, k + 1, F.greatest(F.size(array) - (WINDOW - 1), F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]),
                                       lambda g: F.concat_ws(" ", *[g[f"w{k}"] for k in range(WINDOW)])).alias("g"),
                           F.sequence(F.lit(1), F.greatest(F.size(array) - (WINDOW - 1), F.lit(1))).alias("at"))
    return F.sort_array(F.filter(windows, lambda x: x["g"].isNotNull()))


def _n_repeated(ordered: str) -> Column:
    """Number of different words under the windows that equal a neighbour in the sorted array."""
    beside = F.arrays_zip(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))).alias("a"), F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))).alias("b"))
    same = F.filter(beside, lambda x: x["a"]["g"] == x["b"]["g"])
    starts = F.flatten(F.transform(same, lambda x: F.array(x["a"]["at"], x["b"]["at"])))
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda p: F.array(*[p + k for k in range(WINDOW)])))))


def measured(docs: DataFrame) -> DataFrame:
    """_row, doc_id, the base columns, base_failed and the words ``_w`` of every row."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda c: c.cast("long")
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), text_of().alias("_text")).select(
        "_row", "doc_id", words(text).alias("_w"), count(F.length(F.translate(text, SPACES, ""))).alias("word_chars"),
        count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), lines.alias("_lines"))
    found = found.select("_row", "doc_id", "_w", "word_chars", "n_symbols", count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), _repeated("_w").alias("_sorted"))
    found = found.select("_row", "doc_id", "_w", count(F.size("_w")).alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", count(_n_repeated("_sorted")).alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


FACTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(docs: DataFrame, model: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with its facts, n_grams, log_ratio (millionths, summed) and kept, by a table of gains."""
    rows = measured(docs).select("_row", *FACTS, F.explode_outer(_pairs("_w")).alias("_p"))
    rows = rows.select("_row", *FACTS, F.when(F.col("_p.w").isNotNull(), _bucket(F.col("_p.w"))).alias("_one"),
                       F.when(F.col("_p.v").isNotNull(), _bucket(F.col("_p.w"), F.col("_p.v"))).alias("_two"))
    for key, name in (("_one", "_g1"), ("_two", "_g2")):
        rows = rows.join(F.broadcast(model.select(F.col("bucket").alias(key), F.col("gain").alias(name))), key, "left")
    total = F.sum(F.coalesce("_g1", F.lit(0)) + F.coalesce("_g2", F.lit(0)))
    made = rows.groupBy("_row", *FACTS).agg(total.cast("long").alias("log_ratio"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long")
    return made.select(*FACTS, grams.alias("n_grams"), "log_ratio", (~F.col("base_failed") & (F.col("log_ratio") >= threshold * grams)).alias("kept"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that labels call good and none calls toxic."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select("doc_id"))
    # Few texts but those with a label travel, and without a sort: the side of the ids is hashed.  An id is there once,
    # so the join is inner; a semi join would be moved below the filter.
    labelled = only_marked(docs.select("doc_id", "text"), "doc_id", good, "doc_id", IDS)
    return labelled.join(good.hint("shuffle_hash"), "doc_id")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, gains(docs, trusted(docs, labels)))


SQL = rf"""
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 0)) = 0),
flat AS MATERIALIZED (SELECT rid, doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i + 1 <= len(w) AS two, i + 2 <= len(w) AS three
         FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM given)),
grams AS MATERIALIZED (SELECT rid, doc_id, a AS g FROM flat UNION ALL SELECT rid, doc_id, a || ' ' || b FROM flat WHERE two),
names AS MATERIALIZED (SELECT g, {crc32_sql('g')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM grams)),
counts AS (SELECT bucket, count(*) AS s, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS t FROM grams JOIN names USING (g) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
model AS (SELECT bucket, CASE WHEN t_all = 0 THEN 0 ELSE CAST(floor(ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))) * 1e6) AS BIGINT) END AS gain FROM counts, totals),
scores AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS log_ratio FROM grams JOIN names USING (g) JOIN model USING (bucket) GROUP BY rid),
twice AS (SELECT rid, a, b, c FROM flat WHERE three GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM flat JOIN twice USING (rid, a, b, c) WHERE three) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM given) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(log_ratio, 0) AS log_ratio
  FROM given LEFT JOIN scores USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       greatest(2 * n_words - 1, 0) AS n_grams, log_ratio,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND log_ratio >= {THRESHOLD} * greatest(2 * n_words - 1, 0) AS kept
FROM facts
"""
