"""Near-duplicates by BagMinHash signatures of word shingles, verified on the shingle multisets.

A text is the multiset of its shingles of ``SHINGLE`` words (lower-cased, ``\\w+``); its similarity
to another is the weighted Jaccard, sum of minima over sum of maxima of the multiplicities.

Signatures.  Each shingle has a Poisson process in time over the weights 0, 1, 2, ...: the axis is
cut into the dyadic nodes [0,1), [1,2), [2,4), [4,8), ...; a node fires with a rate equal to its
width, and the bits of a point's mark lead it down the node's halves to one unit of weight.  A point
counts if that unit lies below the multiplicity, so a heavier shingle has all points of a lighter
one and more.  Each point falls into one of ``SLOTS`` slots, and a slot keeps the identity of its
earliest point: two texts agree in a slot with a probability equal to their weighted Jaccard.  Only
points before a time at which nearly all slots are filled are made (log-linear in the slots, whatever
the weights); a text with an empty slot goes on to twice that time.

Linking.  Equal texts (same words) become one node first.  ``BANDS`` bands of ``ROWS`` slots file the
nodes into buckets.  Each node of a bucket is compared with the bucket's smallest node only, so the
number of pairs is that of the rows.  Where buckets then still hold nodes of several components,
these nodes are joined by prefixes: the rarest shingles of each, as many as the similarity needs,
with bounds on sizes and positions.  In each element's list the nodes first meet the one nearest to the
list's common core, then, where they are still apart, the nodes of other components.
Verified links are united by connected components.  At a similarity of 0.8 a pair shares no bucket
with a probability of (1 - 0.8^4)^24 = 3e-6.

Defined cases: null and empty texts, and texts without words, are equal to nothing and stay alone;
texts of fewer than ``SHINGLE`` words are one shingle; a class is named by its smallest doc_id, a
class without any id by null; rows without id are kept; repeated rows fall into one class, and
``deduplicated`` leaves one of the rows that agree in id and text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.common import Hashes, carrying, text_of
from lintlake.operators.graph import components
from lintlake.session import cut, released

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 4, 24
SLOTS = ROWS * BANDS
COUNTERS = 1 << 18  # what tells common elements from rare ones: 2 MB
SPARE = 5.0  # e^-SPARE is the share of texts that need a second go
_WORD = re.compile(r"\w+")
_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def times(k: int, odd: np.uint64) -> np.uint64:
    """k * odd modulo 2^64."""
    return _U(k * int(odd) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles in ascending order, and their multiplicities."""
    n = len(words)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, _U(width))
    for k in range(width):
        total = total + own[k:n - width + 1 + k] * _ODD[k]
    return np.unique(mixed(total), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 64-bit identities per bag of (hashes, multiplicities)."""
    result = np.zeros((len(bags), slots), np.uint64)
    todo, stretch = np.arange(len(bags)), 1.0
    while len(todo):
        sizes = np.array([bags[d][1].sum() for d in todo], np.float64)
        limit = stretch * slots * (np.log(slots) + SPARE) / sizes
        lengths = [len(bags[d][0]) for d in todo]
        hashes = np.concatenate([bags[d][0] for d in todo])
        weights = np.concatenate([bags[d][1] for d in todo]).astype(np.int64)
        owner = np.repeat(np.arange(len(todo)), lengths)
        best = np.full(len(todo) * slots, np.inf)
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, node = 0, 0
        while True:
            held = weights > low if node else np.ones(len(weights), bool)
            if not held.any():
                break
            width = max(1, low)  # the node [low, low + width)
            seed, own, w = mixed(hashes[held] + times(node, _ODD[0])), owner[held], weights[held]
            end, time, step = limit[own], np.zeros(len(seed)), 0
            while len(seed):
                step += 1
                first = mixed(seed + times(2 * step, _ODD[1]))
                time = time - np.log(((first >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width
                on = time <= end
                seed, own, w, end, time = seed[on], own[on], w[on], end[on], time[on]
                point = mixed(seed + times(2 * step + 1, _ODD[2]))
                # The mark's high bits, read from the top, choose halves of the node down to a unit.
                unit = low + (((point >> _U(33)) * _U(width)) >> _U(31)).astype(np.int64)
                counts = unit < w
                if counts.any():
                    slot = own[counts] * slots + ((point[counts] & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)).astype(np.int64)
                    np.minimum.at(best, slot, time[counts])
                    points.append((slot, time[counts], point[counts]))
            low, node = (1, 1) if node == 0 else (low * 2, node + 1)
        made = np.zeros(len(todo) * slots, np.uint64)
        for slot, time, point in points:
            won = time == best[slot]
            made[slot[won]] = point[won]
        full = np.isfinite(best).reshape(len(todo), slots).all(1)
        result[todo[full]] = made.reshape(len(todo), slots)[full]
        todo, stretch = todo[~full], stretch * 2
    return result


def banded(signature: np.ndarray) -> np.ndarray:
    """The bucket keys of signatures: one per band, different for equal slots of different bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[3], parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key + parts[:, :, k] * _ODD[4])
    return key


def expanded(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The multiset as a set: the k-th copy of a shingle is an element of its own."""
    hashes, counts = bag
    many = np.repeat(hashes, counts)
    copy = np.arange(len(many)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(copy == 0, many, mixed(many + copy.astype(np.uint64) * _ODD[1]))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _digest(words: list[str]) -> bytes | None:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def sketches(docs: DataFrame) -> DataFrame:
    """_id, _text (hash), node (digest of the words, null without words), n (shingles) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                words = [words_of(t) for t in batch.column("_t").to_pylist()]
                bags = [shingles(w, hashes) if w else None for w in words]
                keys = iter(banded(signatures([b for b in bags if b is not None])).astype(np.int64).tolist() if any(words) else [])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id"), batch.column("_text"), pa.array(map(_digest, words), pa.binary()),
                    pa.array([max(0, len(w) - SHINGLE) + 1 if w else 0 for w in words], pa.int64()),
                    pa.array([next(keys) if w else [] for w in words], pa.list_(pa.int64()))], names=["_id", "_text", "node", "n", "bands"])

    return (docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_text"), text_of().alias("_t"))
            .mapInArrow(run, "_id long, _text long, node binary, n long, bands array<long>"))


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and bag (expanded shingles) of the texts named by wanted(_id, _text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            bags = [expanded(shingles(words_of(t), hashes)).astype(np.int64) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.list_(pa.int64()))], names=["node", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_i"), F.xxhash64(text_of()).alias("_h"), text_of().alias("_t"))
    return (texts.join(wanted, texts["_i"].eqNullSafe(wanted["_id"]) & (texts["_h"] == wanted["_text"]))
            .select("node", "_t").mapInArrow(run, "node binary, bag array<long>"))


def _compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs(a, b) with their weighted Jaccard ``s``."""
    one, two = bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(one, "a").join(two, "b")
            .select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("s")))


def _fits(one: str, two: str):
    """The sizes allow the similarity."""
    return F.least(one, two) >= SIMILAR * F.greatest(one, two)


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, _text, class_id (smallest doc_id of its class), kept and n_class (texts in the class)."""
    rows = cut(sketches(docs))
    nodes = cut(rows.where(F.col("node").isNotNull()).groupBy("node")
                .agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "n")).alias("r"), F.first("bands").alias("bands"))
                .select("node", "r._id", "r._text", "r.n", "bands"))
    filed = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Buckets of several nodes, each with its smallest node.
    pivots = filed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("many")).where("many > 1")
    crowd = cut(filed.join(pivots.select("key", F.col("p.node").alias("p"), F.col("p.n").alias("pn")), "key"))
    stars = cut(crowd.where((F.col("node") != F.col("p")) & _fits("n", "pn")).select(F.col("node").alias("a"), F.col("p").alias("b")).distinct())
    wanted = crowd.select("node").distinct().join(nodes.select("node", "_id", "_text"), "node")
    bags = cut(_bags(docs, wanted).dropDuplicates(["node"]))
    links = cut(_compared(stars, bags).where(F.col("s") >= SIMILAR).select("a", "b"))
    released(docs.sparkSession)
    joined = cut(components(links))
    filed = _filed(crowd, bags, joined)
    released(docs.sparkSession)
    for pairs in (_nearest, _apart):
        more = cut(_compared(pairs(_placed(filed, joined)), bags).where(F.col("s") >= SIMILAR).select("a", "b"))
        if not more.isEmpty():
            # The links so far are summed up by each node's component.
            links = joined.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
            joined = cut(components(links))
        released(docs.sparkSession)
    named = nodes.select("node", "_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = named.groupBy("component").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    by_node = named.select("node", "component").join(whole, "component").drop("component")
    return (rows.select(F.col("_id").alias("doc_id"), "_text", "node").join(by_node, "node", "left")
            .select("doc_id", "_text", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))


def _commonness(bags: DataFrame) -> np.ndarray:
    """How many elements of the bags fall into each of ``COUNTERS`` places, a number that grows with how common an element is."""
    counts = bags.select(F.explode("bag").alias("el")).groupBy(F.pmod("el", F.lit(COUNTERS)).alias("place")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    made = np.zeros(COUNTERS, np.int64)
    made[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    return made


def _filed(crowd: DataFrame, bags: DataFrame, joined: DataFrame) -> DataFrame:
    """node, n and first: the first elements of the nodes of buckets that are not of one component.

    Two bags of the wanted similarity share an element among the first ``n - SIMILAR * n + 1`` of each in any
    common order; with the rarest elements first, bags that share only a frequent passage never meet.  The order is that of
    the counters that elements fall into, a table of fixed size which every task has, so a bag's first elements are
    found in its own row and only they travel."""
    own = crowd.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    at = own.join(joined.select(F.col("node").alias("p"), F.col("component").alias("pc")), "p", "left").withColumn("pc", F.coalesce("pc", "p"))
    open_keys = at.where(F.col("c") != F.col("pc")).select("key").distinct()
    inside = at.join(open_keys, "key").select("node").distinct()
    held = cut(bags.join(inside, "node", "left_semi"))
    common = _commonness(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for bag in batch.column("bag"):
                els = bag.values.to_numpy()
                n = len(els)
                sizes.append(n)
                found.append(els[np.lexsort((els, common[els % COUNTERS]))[:n - math.ceil(SIMILAR * n - 1e-9) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "first"])

    return cut(held.mapInArrow(run, "node binary, n long, first array<long>"))


def _placed(filed: DataFrame, joined: DataFrame) -> DataFrame:
    """el, node, n, at, component ``c`` and its size, of every first element.  A node learns its component before its
    elements become rows."""
    many = joined.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    known = joined.join(many, "component").select("node", F.col("component").alias("c"), "many")
    whole = filed.join(known, "node", "left").withColumn("c", F.coalesce("c", "node")).withColumn("many", F.coalesce("many", F.lit(1)))
    return whole.select("node", "n", "c", "many", F.posexplode("first").alias("at", "el")).withColumn("at", F.col("at") + 1)


#: What two bags may share from a common element on must reach the overlap that the similarity needs.
_ROOM = f"1 + least(an - ai, bn - bi) >= {SIMILAR / (1 + SIMILAR)} * (an + bn) - 1e-9"


def _nearest(placed: DataFrame) -> DataFrame:
    """Each node with the one that has the fewest rarer elements before a common one, if that lies in another component."""
    core = placed.groupBy("el").agg(F.min(F.struct("at", "node", "n", "c")).alias("q"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return (placed.join(core, "el").where(F.col("c") != F.col("q.c"))
            .select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("at").alias("ai"), F.col("q.node").alias("b"), F.col("q.n").alias("bn"), F.col("q.at").alias("bi"))
            .where(_fits("an", "bn") & F.expr(_ROOM)).select("a", "b").distinct())


def _apart(placed: DataFrame) -> DataFrame:
    """All pairs that meet in an element, fit and lie in different components."""
    placed = cut(placed)
    # An element's nodes outside its largest component meet all its nodes of other components.
    main = placed.groupBy("el").agg(F.max(F.struct("many", "c")).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    met = placed.join(main.select("el", F.col("m.c").alias("main")), "el")
    x = met.where(F.col("c") != F.col("main")).select("el", F.col("node").alias("a"), F.col("n").alias("an"), F.col("c").alias("ac"), F.col("at").alias("ai"))
    y = met.select("el", "main", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"), F.col("at").alias("bi"))
    once = (F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))
    return x.join(y, "el").where((F.col("ac") != F.col("bc")) & _fits("an", "bn") & F.expr(_ROOM) & once).select("a", "b").distinct()


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_class and kept of every row."""
    return classes(docs).select("doc_id", "class_id", "n_class", "kept")


@carrying
def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without id stay."""
    gone = classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "_text").distinct()
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_h"),
                      F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_n"))
    left = row.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_h") == F.col("_text")), "left_anti")
    return left.dropDuplicates(["_id", "_h", "_n"]).select("_doc.*")
