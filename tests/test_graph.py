import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import cluster, graph


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def random_graph(seed, nodes=40, edges=60):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(edges)})


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def test_components(spark):
    edges = random_graph(1, 60, 40) + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    both = edges + [(b, a) for a, b in edges]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: min(reach(both, n) | {n}) for n in linked}


@pytest.mark.parametrize("heavy", [1000, 2, 0])
def test_blast_radius_lists_and_bitmaps_agree(spark, heavy):
    edges = random_graph(2) + [(f"x{i:02d}", "n00") for i in range(12)] + [("n00", "n01"), ("n01", "n00")]
    clean = {(a, b) for a, b in edges if a != b}
    want = {}
    for f in {b for _, b in clean}:
        near = {a for a, b in clean if b == f}
        far = {a for a, b in clean if b in near} - {f}
        want[f] = (len(near), len(near | far) - len(near), len(near | far))
    got = {r.file: (r.direct_callers, r.transitive_callers, r.total_affected_files) for r in graph.blast_radius(edges_frame(spark, edges), heavy).collect()}
    assert got == want


def test_cycles_and_levels(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("p", "q"), ("q", "p"), ("e", "f"), ("d", "f")] + [(a, b) for a, b in random_graph(3, 15, 22)]
    clean = {(a, b) for a, b in edges if a != b}
    nodes = {n for e in clean for n in e}
    full = {n: reach(clean, n) for n in nodes}
    want = {n: min(m for m in nodes if m in full[n] and n in full[m]) for n in nodes if n in full[n]}
    assert {r.file: r.cycle for r in graph.cycles(edges_frame(spark, edges)).collect()} == want
    level = {r.file: r.level for r in graph.levels(edges_frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("r", "p")])).collect()}
    assert level == {"c": 0, "b": 1, "a": 2, "p": None, "q": None, "r": None}


def counted_rounds(monkeypatch, name):
    """A function that tells how often a table was written: once a round."""
    names = []
    plain = graph.Tables.put
    monkeypatch.setattr(graph.Tables, "put", lambda self, table, frame: (names.append(table), plain(self, table, frame))[1])
    return lambda: names.count(name)


def longest(edges):
    """Level by brute force, None for what reaches a circle."""
    clean = {(a, b) for a, b in edges if a != b}
    nodes = {n for e in clean for n in e}
    on = {n for n in nodes if n in reach(clean, n)}
    endless = {n for n in nodes if n in on or reach(clean, n) & on}
    level = {}

    def of(n):
        if n not in level:
            level[n] = max((1 + of(b) for a, b in clean if a == n), default=0)
        return level[n]

    return {n: None if n in endless else of(n) for n in nodes}


def test_long_chain_of_levels(spark, monkeypatch):
    rounds = counted_rounds(monkeypatch, "state")
    chain = [(f"f{i + 1:03d}", f"f{i:03d}") for i in range(200)]
    got = {r.file: r.level for r in graph.levels(edges_frame(spark, chain)).collect()}
    assert got == {f"f{i:03d}": i for i in range(201)}
    assert rounds() < 15


@pytest.mark.parametrize("seed", range(4))
def test_levels_against_brute_force(spark, seed):
    rng = random.Random(seed)
    down = [(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a > b]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("n29", "r0"), ("r2", "n01"), ("q", "n29"), ("q", "n02")]
    edges = down + (ring if seed % 2 else []) + [(f"t{i}", f"t{i - 1}") for i in range(1, 12)] + [("t0", "n05"), ("t11", "n07")]
    assert {r.file: r.level for r in graph.levels(edges_frame(spark, edges)).collect()} == longest(edges)


def mutual(edges):
    clean = {(a, b) for a, b in edges if a != b}
    nodes = {n for e in clean for n in e}
    full = {n: reach(clean, n) for n in nodes}
    return {n: min(m for m in nodes if m in full[n] and n in full[m]) for n in nodes if n in full[n]}


def test_ring_of_200(spark, monkeypatch):
    rounds = counted_rounds(monkeypatch, "now")
    ring = [(f"f{i:03d}", f"f{(i + 1) % 200:03d}") for i in range(200)]
    assert {r.file: r.cycle for r in graph.cycles(edges_frame(spark, ring + [("x", "f100"), ("f050", "y")])).collect()} == {f"f{i:03d}": "f000" for i in range(200)}
    assert rounds() < 15


@pytest.mark.parametrize("seed", range(5))
def test_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for _ in range(rng.choice([20, 30, 40]))]
    edges += [("a0", "a1"), ("a1", "a2"), ("a2", "a0"), ("a0", "b0"), ("b0", "a0"), ("a1", "c0"), ("c0", "c1"), ("c1", "n00"), ("n01", "a2")]
    edges += [("l", "m0"), ("m0", "m1"), ("m1", "l"), ("l", "k0"), ("k0", "l"), ("z", "l"), ("p0", "p1"), ("p1", "p0")]
    assert {r.file: r.cycle for r in graph.cycles(edges_frame(spark, edges)).collect()} == mutual(edges)


def test_no_cycles(spark):
    assert graph.cycles(edges_frame(spark, [("a", "b")])).count() == 0


def test_import_resolution(spark):
    files = spark.createDataFrame([
        ("src/a.ts", "import { B, C as D } from './b'\nimport E from \"@/lib/e\"\nimport './a'\nconst x = require('react')\nexport * from '../other'"),
        ("src/b.ts", "import('./deep')"), ("src/lib/e.tsx", ""), ("other/index.js", ""), ("src/deep/index.ts", "import type { T } from '../b'")], "path string, content string")
    got = {(r.src, r.dst): r.names for r in graph.import_edges(files, {"@/": "src/"}).collect()}
    assert got == {("src/a.ts", "src/b.ts"): ["B", "C"], ("src/a.ts", "src/lib/e.tsx"): ["E"], ("src/a.ts", "other/index.js"): [],
                   ("src/b.ts", "src/deep/index.ts"): [], ("src/deep/index.ts", "src/b.ts"): ["T"]}


def test_repos_do_not_mix(spark):
    files = spark.createDataFrame([
        ("one", "src/a.ts", "import './b'\nimport { X } from '@/lib/x'\nimport y from '@/lib/deep/y'\nimport '~z'\nimport './only'"), ("one", "src/b.ts", ""), ("one", "src/lib/x.ts", ""), ("one", "deep/y.ts", ""),
        ("one", "lib/z/index.js", ""), ("two", "src/a.ts", "import './b'\nimport '@/lib/x'\nimport '@/lib/deep/y'\nimport './only'"), ("two", "src/b.js", ""), ("two", "web/lib/x.ts", ""),
        ("two", "src/lib/x.ts", ""), ("two", "deep/y.ts", ""), ("three", "src/a.ts", "import './b'\nimport '@/lib/x'"), ("three", "src/only.ts", ""), (None, "src/b.ts", "")], "repo string, path string, content string")
    configs = spark.createDataFrame([("one", '{"compilerOptions": {"paths": {"@/*": ["src/*"], "@/lib/deep/*": ["deep/*"], "~*": ["lib/*"]}}}'),
                                     ("two", '{"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["./*"]}}}'), ("four", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}')], "repo string, content string")
    got = {(r.repo, r.src, r.dst) for r in graph.import_edges(files, graph.aliases(configs)).collect()}
    assert got == {("one", "src/a.ts", "src/b.ts"), ("one", "src/a.ts", "src/lib/x.ts"), ("one", "src/a.ts", "deep/y.ts"), ("one", "src/a.ts", "lib/z/index.js"),
                   ("two", "src/a.ts", "src/b.js"), ("two", "src/a.ts", "web/lib/x.ts")}


def test_order_of_candidates(spark):
    """Whole path, then in place of the extension and added to it for each extension in turn, then index files."""
    paths = ["s/f.v", "s/f.ts", "s/f.v.ts", "s/f.tsx", "s/f.v.tsx", "s/f.js", "s/f.v.js", "s/f.jsx", "s/f.v.jsx", "s/f.v/index.ts", "s/f.v/index.tsx", "s/f.v/index.js", "s/f.v/index.jsx"]
    files = [row for k in range(len(paths)) for row in [(f"r{k}", "s/main.ts", "import './f.v'"), *[(f"r{k}", p, "") for p in reversed(paths[k:])]]]
    made = graph.import_edges(spark.createDataFrame(files, "repo string, path string, content string"))
    assert {r.repo: r.dst for r in made.collect()} == {f"r{k}": p for k, p in enumerate(paths)}
    root = spark.createDataFrame([("d/a.ts", "import '..'"), ("index.ts", "")], "path string, content string")
    assert [(r.src, r.dst) for r in graph.import_edges(root).collect()] == [("d/a.ts", "index.ts")]


def rows(spark, found):
    return spark.createDataFrame(found, "id string, rule string, file string, line int, severity string, description string, cross_cutting_group string, search_pattern string")


def test_split_mixed_cluster(spark):
    found = rows(spark, [(f"I{i:02d}", "R01" if i < 13 else "R02", "a.ts", i, "LOW", "same words", None, "p") for i in range(14)])
    parts = cluster.split(cluster.by_file(found), found)
    sizes = sorted(r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 1, 12]
    made = cluster.summary(parts, found).orderBy("position").collect()
    assert [r.cluster_id for r in made] == ["CLU-001", "CLU-002", "CLU-003"] and made[0].finding_count == 12
    assert cluster.write_back(found, parts, cluster.summary(parts, found)).where("cluster_id IS NULL").count() == 0


def test_merge_to_fixpoint(spark):
    rng = random.Random(4)
    clusters = {f"c{i:02d}": {f"f{x}" for x in rng.sample(range(40), rng.randint(2, 6))} for i in range(15)}
    members = spark.createDataFrame([(c, "file", f) for c, fs in clusters.items() for f in fs], "cluster string, type string, id string")
    state = {c: set(fs) for c, fs in clusters.items()}
    while True:
        names = sorted(state)
        pairs = [(a, b) for a in names for b in names if a < b and len(state[a] & state[b]) / min(len(state[a]), len(state[b])) > 0.5]
        if not pairs:
            break
        both = pairs + [(b, a) for a, b in pairs]
        merged = {}
        for n in names:
            merged.setdefault(min(reach(both, n) | {n}), set()).update(state[n])
        state = merged
    got = {}
    for r in cluster.merge(members).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert got == state


def test_wording_groups_skip_what_is_seen(spark):
    found = rows(spark, [("a", "R1", "x", 1, "LOW", "d", "g", None), ("b", "R1", "y", 1, "LOW", "d", "g", None), ("c", "R2", "x", 2, "LOW", "e", "h", None),
                         ("d", "R2", "x", 3, "LOW", "e", None, None)])
    got = {(r.cluster, r.id) for r in cluster.by_pattern(found).collect()}
    assert got == {("group|g", "a"), ("group|g", "b"), ("wording|R2|e", "c"), ("wording|R2|e", "d")}
