"""Importance resampling towards a target distribution, with an exact distributed cut.

A document's features are its runs of one to three words, hashed (CRC-32) into ``BUCKETS``.  A bucket's gain is
the logarithm of how much likelier it is in the target texts than in the corpus, in whole thousandths.  The
gains are one array; a document's weight is the sum of the array over its buckets.  Weight plus Gumbel noise,
which is a hash of the document's id, is its score, so the highest scores are a sample without replacement
in proportion to the weights, the same on every run.

Which documents are drawn is decided by one cutoff key (score falling, id rising), found by selection: every
partition tells the median of its remaining keys and their number, the median of those medians weighted by the
numbers is the pivot, and the partitions count their keys on both sides of it.  The side that cannot hold the
cutoff goes, which is a quarter of what remained at least.  One pass over the narrow table of keys makes a
round; it is written anew, without what has gone, whenever an eighth is left.  When ``LAST`` keys or fewer
remain they are sorted.  The driver sees one median and three numbers per partition, never the keys
of all documents.  The winners alone are sorted and numbered, in range partitions.

Counts are added up per task first, to at most ``BUCKETS`` rows each.  Nothing is grouped by a word or a
source, so none of them can be hot.

Defined cases: null and empty texts have no features, weight 0, and are never drawn; a null id counts as empty in the
hash and as larger than all ids in a tie; rows that occur several times have equal keys, are counted each, and
get ranks one after the other, of which the last ones can be undrawn; an empty target gives gains from
smoothing alone; an empty table gives no rows; other columns are not looked at; texts of any length are
hashed whole.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm.common import crc32_sql
from lintlake.operators.ordering import numbered
from lintlake.session import cut

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SLICES = 10_000  # partitions that tell their medians, at most
LAST = 4_096  # remaining keys that are sorted instead of halved again
CHUNK = 1 << 18  # words hashed before their buckets are summed
#: Bytes to words: A-Z lower-cased, ASCII other than digits and letters blank; all bytes of other characters stay.
FOLD = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if chr(b) in string.digits or b > 127 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def hashed(texts: Sequence[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For one chunk of texts after the other: where it begins, the words and features of each text, and the buckets of all features."""
    codes: list[int] = []
    words, sizes, start = [], [], 0
    for at, text in enumerate(texts):
        found = text.translate(FOLD).split() if text else []
        ones = list(map(crc32, found))
        codes += ones
        n = len(found)
        tails, now = [b" " + w for w in found[1:]], ones
        for _ in range(1, GRAMS):
            # A run's checksum goes on from that of the run that is one word shorter.
            now = list(map(crc32, tails, now))
            codes += now
            tails = tails[1:]
        words.append(n)
        sizes.append(sum(max(n - k, 0) for k in range(GRAMS)))
        if len(codes) >= CHUNK or at == len(texts) - 1:
            yield start, np.array(words, np.int64), np.array(sizes, np.int64), (np.array(codes, np.int64) % BUCKETS)
            codes, words, sizes, start = [], [], [], at + 1


def counted(texts: DataFrame) -> np.ndarray:
    """How many features of the texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in hashed(batch.column(0).to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    made = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        made[row["bucket"]] = row["n"]
    return made


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of ln((t + 1) (S + B) / ((s + 1) (T + B))), rounded down."""
    top, below = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * top / ((s + 1.0) * below))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of Gumbel noise from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            names = ids.to_pylist()
            for start, words, sizes, buckets in hashed(batch.column(1).to_pylist()):
                sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                ends = np.cumsum(sizes)
                weight = sums[ends] - sums[ends - sizes]
                luck = np.array([noise(i, seed) for i in names[start:start + len(sizes)]], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(sizes)), pa.array(words), pa.array(sizes), pa.array(weight), pa.array(weight + luck)],
                                                 names=["doc_id", "n_words", "n_features", "weight", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


Key = tuple[int, int]  # falling score, rising id
NONE: Key = (0, 0)


def _middle(fall: np.ndarray, ids: np.ndarray) -> Key:
    """The lower median of some keys."""
    if not len(fall):
        return NONE
    order = np.lexsort((ids, fall))
    at = order[(len(order) - 1) // 2]
    return int(fall[at]), int(ids[at])


def _sides(fall: np.ndarray, ids: np.ndarray, pivot: Key) -> tuple[np.ndarray, np.ndarray]:
    """Which keys lie before and behind the pivot."""
    before = (fall < pivot[0]) | ((fall == pivot[0]) & (ids < pivot[1]))
    behind = (fall > pivot[0]) | ((fall == pivot[0]) & (ids > pivot[1]))
    return before, behind


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The median that has half of the weight or more up to it, and less than half before it."""
    total, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no medians")


def _probed(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list[tuple[int, int, int, Key, Key]]:
    """One row per partition: how many of its keys between low and high lie before, on and behind the pivot, and the medians
    of those before and behind it.  Without a pivot all lie before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        fall, ids = (np.concatenate([p[k] for p in parts]) for k in range(2))
        for bound, side in ((low, 1), (high, 0)):
            if bound is not None:
                stay = _sides(fall, ids, bound)[side]
                fall, ids = fall[stay], ids[stay]
        before, behind = _sides(fall, ids, pivot) if pivot is not None else (np.ones(len(fall), bool), np.zeros(len(fall), bool))
        numbers = [int(before.sum()), len(fall) - int(before.sum()) - int(behind.sum()), int(behind.sum())]
        row = [*numbers, *_middle(fall[before], ids[before]), *_middle(fall[behind], ids[behind])]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=["a", "b", "c", "d", "e", "f", "g"])

    found = keys.mapInArrow(run, "a long, b long, c long, d long, e long, f long, g long").collect()
    return [(r[0], r[1], r[2], (r[3], r[4]), (r[5], r[6])) for r in found]


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    def beyond(bound: Key, up: bool) -> Column:
        fall, ids = F.col("fall"), F.col("id")
        same = fall == bound[0]
        return (fall > bound[0]) | (same & (ids > bound[1])) if up else (fall < bound[0]) | (same & (ids < bound[1]))

    for bound, up in ((low, True), (high, False)):
        if bound is not None:
            keys = keys.where(beyond(bound, up))
    return keys


def cutoff(keys: DataFrame, rank, last: int = LAST, slices: int = SLICES) -> tuple[Key | None, int, list[int]]:
    """The key that ``rank`` (a function of the number of keys, 1-based) asks for among (fall, id), that rank, and how many
    keys remained in each round.  No key where the rank is below one."""
    # Most partitions of a corpus are small tables of keys; joined without a shuffle, their number stays bounded.
    keys = cut(keys.coalesce(slices))
    probes = _probed(keys, None, None, None)
    stored = left = sum(p[0] for p in probes)
    wanted = k = rank(left)
    if k < 1:
        return None, 0, [left]
    medians, low, high, seen = [(p[3], p[0]) for p in probes if p[0]], None, None, [left]
    while left > last:
        pivot = weighted_median(medians)
        probes = _probed(keys, low, high, pivot)
        before, on = sum(p[0] for p in probes), sum(p[1] for p in probes)
        if before < k <= before + on:
            return pivot, wanted, seen
        if k <= before:
            high, left, medians = pivot, before, [(p[3], p[0]) for p in probes if p[0]]
        else:
            k -= before + on
            low, left, medians = pivot, left - before - on, [(p[4], p[2]) for p in probes if p[2]]
        seen.append(left)
        if left * 8 <= stored:
            keys, stored, low, high = cut(_between(keys, low, high)), left, None, None
    rest = sorted((r["fall"], r["id"]) for r in _between(keys, low, high).collect())  # LAST rows at most
    return rest[k - 1], wanted, seen


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Scored rows with ``rank``: 1, 2, ... for those drawn, null for the others."""
    rows = cut(rows)
    fall, ident = -F.col("score"), F.coalesce("doc_id", F.lit(int(NO_ID)))
    keys = rows.where(F.col("n_words") >= least_words).select(fall.alias("fall"), ident.alias("id"))
    last, n, _ = cutoff(keys, lambda count: percent * count // 100)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("*", none)
    won = (F.col("n_words") >= least_words) & ((fall < last[0]) | ((fall == last[0]) & (ident <= last[1])))
    # Rows equal to the last key can be more than are drawn; those beyond the number stay undrawn.
    ranked = numbered(rows.where(won), [], [fall, ident], "rank").withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")).cast("long"))
    return ranked.unionByName(rows.where(~won).select("*", none))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    gain = gains(counted(docs), counted(target))
    return drawn(scored(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS MATERIALIZED (
  SELECT rid, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM given, range(1, 4) AS t(k))),
aim AS MATERIALIZED (
  SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM goal, range(1, 4) AS t(k))),
names AS MATERIALIZED (SELECT f, {crc32_sql('f')} % {BUCKETS} AS bucket FROM (SELECT f FROM own UNION SELECT f FROM aim)),
s AS (SELECT bucket, count(*) AS s FROM own JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN names USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS s_all, (SELECT count(*) FROM aim)::DOUBLE AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN names USING (f) JOIN gains USING (bucket) GROUP BY rid),
scores AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM given LEFT JOIN sums USING (rid)),
placed AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS r FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * {PERCENT} // 100 FROM scores WHERE n_words >= {LEAST_WORDS}) THEN r END AS rank FROM placed
"""
