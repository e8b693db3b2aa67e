"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions alone.

A window is ``WINDOW`` consecutive words of a benchmark item (all words of a shorter item).  As a
set it holds the shingles of ``GRAM`` words in it, and a document that contains the window contains
them all.  Shingles are ordered by how often they occur in the corpus, and only the rarest one of
each window, its necessary prefix, is joined with the shingles of the documents.  A match says how
item and document would be aligned; positions and lengths rule out alignments that leave the
document, and the rest are verified word by word over the windows of the item.

The benchmark is joined in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast has a
bound whatever the size of the benchmark; a benchmark of any size is worked off block by block.
Documents are cut into shingles once per block; the matches with shingles of the block are written
to the checkpoint folder, and both the corpus counts and the candidates come from there.

Candidates are found on lower-cased text by 64-bit hashes and verified on the exact words, so
neither folding nor a hash collision can change a result.

Defined cases: null and empty texts have no words and hit nothing; a null item_id counts as the
empty string; equal items under one id count once, under several ids each; repeated rows give
repeated results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.llm.common import carrying, text_of
from lintlake.session import cut

WINDOW = 10
GRAM = 3
BLOCK_WORDS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def grams(array: Column, size: int) -> Column:
    """The shingles of an array of words as structs; the last ones of an array are cut short by nulls."""
    if size == 1:
        return F.arrays_zip(array.alias("w0"))
    return F.arrays_zip(array, *[F.slice(array, k + 1, F.greatest(F.size(array), F.lit(1))) for k in range(1, size)])


def _hashed(frame: DataFrame, array: str, size: int, keep: list[Column | str]) -> DataFrame:
    """keep, pos, hash for every shingle of ``size`` words."""
    flat = frame.select(*keep, F.posexplode(grams(F.col(array), size)).alias("pos", "_g"))
    names = [f.name for f in flat.schema["_g"].dataType.fields]
    parts = [F.col("_g").getField(n) for n in names]
    return flat.where(parts[-1].isNotNull()).withColumn("hash", F.xxhash64(*parts, F.lit(size))).drop("_g")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words, folded (lower-cased in full), n, gram, item of every different item with words."""
    text = text_of()
    return (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             words(folded(text)).alias("words"), words(F.lower(text)).alias("folded"))
            .where(F.size("words") > 0).distinct()
            .withColumn("n", F.size("words")).withColumn("gram", F.least(F.lit(GRAM), "n"))
            .withColumn("item", F.xxhash64("item_id", "words")))


def _block(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (_id, _hash, item_id, item words, delta) of one block of items."""
    sizes = [row["gram"] for row in items.select("gram").distinct().collect()]  # 1, 2 or 3
    cut_up = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_hash"), words(F.lower(text_of())).alias("_w"))
    own = reduce(DataFrame.unionByName, [_hashed(items.where(F.col("gram") == g), "folded", g, ["item", "n", "gram"]) for g in sizes])
    own = cut(own)
    wanted = F.broadcast(own.select("hash").distinct())
    found = cut(reduce(DataFrame.unionByName, [
        _hashed(cut_up, "_w", g, ["_id", "_hash", F.size("_w").alias("_n")]).join(wanted, "hash") for g in sizes]))
    counts = found.groupBy("hash").agg(F.count(F.lit(1)).alias("count"))
    # The rarest shingle of each window; a shingle that the corpus lacks rules its windows out.
    span = F.least(F.lit(WINDOW), "n") - F.col("gram")
    ranked = own.join(counts, "hash", "left").withColumn("rare", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "pos"))
    ahead = Window.partitionBy("item").orderBy("pos")
    prefixes = (ranked.withColumn("best", F.when(span == WINDOW - GRAM, F.min("rare").over(ahead.rowsBetween(0, WINDOW - GRAM)))
                                  .otherwise(F.min("rare").over(ahead.rowsBetween(0, Window.unboundedFollowing))))
                .where((F.col("pos") <= F.col("n") - F.least(F.lit(WINDOW), "n")) & (F.col("best.count") > 0))
                .select("item", "n", "gram", F.col("best.hash").alias("hash"), F.col("best.pos").alias("at")).distinct())
    length = F.least(F.lit(WINDOW), "n")
    delta = F.col("pos") - F.col("at")
    first, last = F.greatest(F.lit(0), F.col("at") - (length - F.col("gram"))), F.least("at", F.col("n") - length)
    aligned = (found.join(F.broadcast(prefixes), "hash")
               .where((last + delta >= 0) & (first + delta + length <= F.col("_n")))
               .groupBy("_id", "_hash").agg(F.collect_set(F.struct("item", delta.alias("delta"))).alias("_c"))
               .select("_id", "_hash", F.explode("_c").alias("_c")).select("_id", "_hash", "_c.*"))
    return aligned.join(F.broadcast(items.select("item", "item_id", "words")), "item").drop("item")


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """Per document (_id, _hash) the array _c of (item_id, words, delta); None without items."""
    items = cut(items_of(benchmark))
    total = items.agg(F.sum("n")).first()[0]
    if not total:
        return None
    blocks = -(-total // BLOCK_WORDS)
    made = reduce(DataFrame.unionByName, [_block(docs, items.where(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(blocks)) == b) if blocks > 1 else items) for b in range(blocks)])
    return made.groupBy("_id", "_hash").agg(F.collect_list(F.struct("item_id", "words", "delta")).alias("_c"))


def _verified(own: Column, n_words: Column, found: Column) -> Column:
    """The windows that do occur among a document's own words, as an array of (item_id, at, len)."""

    def check(c: Column) -> Column:
        n = F.size(c["words"])
        length = F.least(F.lit(WINDOW), n)
        low, high = F.greatest(F.lit(0), -c["delta"]), F.least(n - length, n_words - length - c["delta"])
        starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda i: F.slice(own, i + c["delta"] + 1, length) == F.slice(c["words"], i + 1, length)),
                           lambda i: F.struct(c["item_id"].alias("item_id"), (i + c["delta"]).alias("at"), length.alias("len")))

    return F.flatten(F.transform(found, check))


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with ``__leak``: n_words, n_hit and the sorted ids of the items found."""
    found = candidates(docs, benchmark)
    none = F.array().cast("array<string>")
    if found is None:
        n = F.size(words(F.lower(text_of())))
        return docs.withColumn("__leak", F.struct(n.alias("n_words"), F.lit(0).alias("n_hit"), none.alias("items")))
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("__doc"), F.col("doc_id").alias("__id"), F.xxhash64(text_of()).alias("__hash"))
    joined = keyed.join(found, F.col("__id").eqNullSafe(F.col("_id")) & (F.col("__hash") == F.col("_hash")), "left")
    text = text_of("__doc.text")
    count = F.size(words(F.lower(text)))
    own = F.when(F.col("_c").isNotNull(), words(folded(text)))  # only where there is something to verify
    step = (joined.select("__doc", "_c", count.alias("_n"), own.alias("_own"))
            .select("__doc", "_n", F.when(F.col("_c").isNotNull(), _verified(F.col("_own"), F.col("_n"), F.col("_c"))).alias("_hits")))
    hit = F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item_id"])))
    some = F.size("_hits") > 0  # -1 or null without candidates
    return step.select("__doc.*", F.struct(F.col("_n").alias("n_words"), F.when(some, hit).otherwise(0).alias("n_hit"),
                                          F.when(some, ids).otherwise(none).alias("items")).alias("__leak"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what of it is in the benchmark."""
    leak = F.col("__leak")
    return marked(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", leak["n_words"].cast("long").alias("n_words"), leak["n_hit"].cast("long").alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ",").cast("binary"), 256).alias("items_sha256"), (leak["n_hit"] > 0).alias("contaminated"))


@carrying
def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns."""
    return marked(docs, benchmark).where(F.col("__leak.n_hit") == 0).select(*docs.columns)


SQL = r"""
WITH folded AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM places JOIN windows USING (n, t)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
