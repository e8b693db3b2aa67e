"""Near-duplicates of texts and vectors, and decontamination, against brute force."""

import collections
import random

import numpy as np
import pytest

from lintlake.llm import bagminhash as bag, decontaminate as leaks, hnsw
from lintlake.llm.common import Hashes, table


def bags(texts):
    """Multisets of shingles, made without the operator's code."""
    made = {}
    for key, text in texts.items():
        words = bag.words_of(text or "")
        if words:
            width = min(5, len(words))
            made[key] = collections.Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return made


def similar(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def united(keys, links):
    roots = {k: k for k in keys}

    def find(k):
        while roots[k] != k:
            k = roots[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def brute_classes(texts):
    held = bags(texts)
    keys = sorted(held)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if similar(held[a], held[b]) >= 0.8]
    return united(texts, links)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_classes_on_given_texts(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in bag.report(docs).collect()}
    assert got == brute_classes(texts)


def test_classes_of_crowds_chains_and_multiplicities(spark):
    rng = random.Random(3)
    texts, base = {}, words(rng, 150)
    for k in range(60):  # a crowd around one text
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        texts[k] = " ".join(own)
    chain = words(rng, 120)
    for k in range(60, 80):  # each text like the one before
        chain = list(chain)
        chain[rng.randrange(120)] = f"y{k}"
        texts[k] = " ".join(chain)
    for k in range(80, 90):  # the same shingles, more or less often
        texts[k] = "a b c d e f " * (10 + k - 80)
    for k in range(90, 120):
        texts[k] = " ".join(words(rng, rng.randrange(1, 60)))
    texts |= {120: "", 121: None, 122: "!!!", 123: "!!!", 124: "one two", 125: "One, two.", 126: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bag.report(docs).collect()}
    assert got == brute_classes(texts)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(12):
        one = {int(k): int(w) for k, w in zip(rng.integers(1, 2**62, 60), rng.integers(1, 12, 60), strict=True)}
        two = {k: max(1, w + int(rng.integers(-2, 3))) for k, w in one.items() if rng.random() < 0.85}
        true = sum(min(w, two.get(k, 0)) for k, w in one.items()) / sum(max(one.get(k, 0), two.get(k, 0)) for k in {*one, *two})
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (one, two)]
        signature = bag.signatures(pair, slots=2048)
        errors.append(((signature[0] == signature[1]).mean() - true) / np.sqrt(true * (1 - true) / 2048))
    assert abs(np.mean(errors)) < 3 / np.sqrt(12) and np.std(errors) < 2


def test_deduplicated_keeps_one_of_each_class(spark):
    text = " ".join(words(random.Random(1), 50))
    docs = spark.createDataFrame([(2, text, "a"), (1, text.upper(), "b"), (1, text.upper(), "b"), (3, "other words", "c"), (None, text, "d"), (None, text, "d"), (5, None, "e")],
                                 "doc_id long, text string, node string")
    kept = bag.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["node"]) for r in kept.collect()) == [(0, "d"), (0, "d"), (1, "b"), (3, "c"), (5, "e")]


def brute_links(rows):
    units = {k: np.array(v, float) / np.linalg.norm(v) for k, (_, v) in rows.items()}
    keys = sorted(rows)
    return [(a, b) for i, a in enumerate(keys) for b in keys[:i] if rows[a][0] == rows[b][0] and units[a] @ units[b] >= hnsw.COSINE]


@pytest.mark.parametrize("shard", [8192, 60])
def test_vectors_in_one_and_many_shards(spark, shard):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = {k: (k % 2, (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.3])).astype(np.float32).tolist()) for k in range(400)}
    rows |= {400 + k: (0, rows[0][1]) for k in range(30)}  # copies
    frame = spark.createDataFrame([(k, v, label) for k, (label, v) in rows.items()], "vec_id long, embedding array<float>, label int")
    links = brute_links(rows)
    count = collections.Counter(k for pair in links for k in pair)
    want = united(rows, links)
    got = {r["vec_id"]: r for r in hnsw.linked(frame, shard).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: count[k] for k in rows}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == want[k]) for k, r in got.items())


def test_vectors_that_link_with_nothing(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None),
            (8, [], 1), (9, [nan, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [float("inf"), 1.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)} | {k: (0, k) for k in range(4, 13)}


def test_graph_widens_its_beam():
    x = np.random.default_rng(0).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, beam = hnsw.search(hnsw.Graph(x), x, beam=1)
    want = (x @ x.T >= hnsw.COSINE).sum(1)
    audited = range(0, 500, hnsw.AUDIT)
    assert beam >= 1 and all(len(found[k]) == want[k] for k in audited)


def test_links_that_no_beam_reaches():
    """One pair of near-copies among many vectors, and no edge of the graph that leads to it."""
    x = np.random.default_rng(5).normal(size=(300, 64))
    x[137] = x[53] + 0.01 * x[8]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    for near in graph.near:
        near[np.isin(near, (53, 137))] = -1
    graph.entry, graph.top = 0, 0
    found, _ = hnsw.search(graph, x)
    assert sorted(found[53]) == sorted(found[137]) == [53, 137]
    assert [len(f) for f in found] == (x @ x.T >= hnsw.COSINE).sum(1).tolist()


def test_leaks_of_any_item_length(spark):
    rng = random.Random(9)
    items = {k: words(rng, n, 60) for k, n in enumerate([1, 2, 3, 5, 9, 10, 11, 25, 40, 12])}
    items[10] = items[8]  # equal items under two ids
    docs = {}
    for k in range(80):
        own = words(rng, rng.randrange(0, 80), 60 if k % 3 else 4000)
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(11)]
            at = rng.randrange(len(own) + 1)
            start = rng.randrange(len(item))
            own[at:at] = item[start:start + rng.randrange(1, len(item) + 1)]
        docs[k] = rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in own)
    docs |= {100: None, 101: "", 102: "É " + " ".join(items[5]) + " é"}
    found = leaks.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                         spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(99, None), (98, "?!"), (None, "zz yy xx")], "item_id long, text string"))
    import hashlib
    import re
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for row in found.collect():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[row["doc_id"]] or "").translate(fold))
        hit, ids = set(), set()
        for key, item in [*items.items(), ("", ["zz", "yy", "xx"])]:
            n = min(10, len(item))
            for i in range(len(item) - n + 1):
                for at in range(len(own) - n + 1):
                    if own[at:at + n] == item[i:i + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(key))
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (len(own), len(hit), len(ids), bool(hit)), row["doc_id"]
        assert row["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_leaks_in_blocks(spark, folder, monkeypatch):
    """The benchmark in many blocks gives what it gives in one."""
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    whole = sorted(map(tuple, leaks.report(docs, benchmark).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 500)
    assert sorted(map(tuple, leaks.report(docs, benchmark).collect())) == whole


def test_hashes_forget_and_stay_equal():
    small = Hashes(most=3)
    first = [small[w] for w in "a b c d e f a".split()]
    assert first[0] == first[-1] and len(small) <= 3
