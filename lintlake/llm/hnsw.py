"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Vectors of one label are dealt by hash into shards of about ``SHARD`` vectors.  Each shard gets a
small-world graph of its own, built in one task and written once; every vector then queries every
shard of its label, each pair of shards in a task of its own.

A query descends the upper levels greedily, searches the base level with a beam, and widens the
beam while its last member is still a link; from the links found it walks on through linked
neighbours, so that a crowd of any size is found whole.  Every query is then audited against all
vectors of the shard, in blocks of one matrix product, and what its beam missed is added, so no
link rests on the graph and both ends count it.  Every link is verified by its cosine in double
precision.

A task does not hand out pairs but, for each query, the number of its links and one edge to the
component that it joins within the task, so a crowd of n vectors yields n rows and not n * n.
Equal vectors of a label are one node with a weight, so copies are neither compared nor paired.

Defined cases: vectors that are null, empty or zero or hold null, NaN or infinite components, and
vectors with a null label, link with nothing and stay alone; vectors of different lengths never
link; rows of one vec_id count as that many vectors (a vector's copies under its own id count as
links too); a null vec_id takes part and is never the smallest id of a component, unless it has no
other: then the component is null and kept is true.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators.graph import components
from lintlake.session import cut

COSINE = 0.93
SHARD = 8192
DEGREE = 16  # neighbours of a node on the upper levels; twice as many on the base
BUILD = 64  # beam while building
BEAM = 32  # beam of a search before any widening
AUDIT = 1  # every query is audited: a link that the beam missed shows nowhere else


class Graph:
    """A hierarchical navigable small world over unit vectors; distances are cosines."""

    def __init__(self, vectors: np.ndarray, seed: int = 11, state: tuple | None = None) -> None:
        self.x = vectors
        n = len(vectors)
        self.stamp, self.seen = 0, np.zeros(n, np.int64)
        if state:
            self.near, self.entry, self.top = state
            return
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(DEGREE)).astype(int), 12)
        top = int(self.level.max()) if n else 0
        # One row of neighbours per node and level, -1 where there is none.
        self.near = [np.full((n, 2 * DEGREE if k == 0 else DEGREE), -1, np.int32) for k in range(top + 1)]
        self.entry, self.top = -1, -1
        for node in range(n):
            self._insert(node)

    def _insert(self, node: int) -> None:
        level = int(self.level[node])
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        q, at = self.x[node], np.array([self.entry])
        for k in range(self.top, level, -1):
            at = self._beam(q, at, k, 1)[0]
        for k in range(min(level, self.top), -1, -1):
            at, cosines = self._beam(q, at, k, BUILD)
            chosen = self._diverse(at, cosines, DEGREE)
            self.near[k][node, :len(chosen)] = chosen
            for other in chosen:
                self._link(int(other), node, k)
        if level > self.top:
            self.entry, self.top = node, level

    def _link(self, node: int, new: int, k: int) -> None:
        row = self.near[k][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        all_of = np.append(row, new)
        cosines = self.x[all_of] @ self.x[node]
        order = np.argsort(-cosines, kind="stable")
        chosen = self._diverse(all_of[order], cosines[order], len(row))
        row[:] = -1
        row[:len(chosen)] = chosen

    def _diverse(self, nodes: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in order of nearness, first those that are nearer to the node than to one chosen."""
        if len(nodes) <= most:
            return nodes
        among = self.x[nodes] @ self.x[nodes].T
        chosen: list[int] = []
        best = np.full(len(nodes), -2.0)  # largest cosine to one chosen
        for k in range(len(nodes)):
            if best[k] < cosines[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                best = np.maximum(best, among[k])
        if len(chosen) < most:
            left = np.setdiff1d(np.arange(len(nodes)), chosen)
            chosen += left[:most - len(chosen)].tolist()
        return nodes[np.sort(chosen)]

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a beam search on a level finds, nearest first."""
        self.stamp += 1
        self.seen[start] = self.stamp
        nodes, cosines = start, self.x[start] @ q
        fresh = np.ones(len(nodes), bool)
        near = self.near[k]
        while fresh.any():
            # Several nearest open members at once: fewer, larger steps.
            open_at = np.flatnonzero(fresh)[:4 if width > 1 else 1]
            fresh[open_at] = False
            found = near[nodes[open_at]].ravel()
            found = found[found >= 0]
            found = found[self.seen[found] != self.stamp]
            if not len(found):
                continue
            found = np.unique(found)
            self.seen[found] = self.stamp
            nodes = np.concatenate([nodes, found])
            cosines = np.concatenate([cosines, self.x[found] @ q])
            fresh = np.concatenate([fresh, np.ones(len(found), bool)])
            order = np.argsort(-cosines, kind="stable")[:width]
            nodes, cosines, fresh = nodes[order], cosines[order], fresh[order]
        return nodes, cosines

    def links(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The nodes with a cosine of at least COSINE that a search with this beam finds."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        at = np.array([self.entry])
        for k in range(self.top, 0, -1):
            at = self._beam(q, at, k, 1)[0]
        width = beam
        while True:
            nodes, cosines = self._beam(q, at, 0, width)
            if len(nodes) < width or cosines[-1] < COSINE or width > 8 * beam:
                break
            width *= 2
        # Walk on from the links through linked neighbours.
        self.stamp += 1
        self.seen[nodes] = self.stamp
        front = nodes[cosines >= COSINE]
        found = [front]
        while len(front):
            ring = self.near[0][front].ravel()
            ring = np.unique(ring[ring >= 0])
            ring = ring[self.seen[ring] != self.stamp]
            self.seen[ring] = self.stamp
            front = ring[self.x[ring] @ q >= COSINE]
            found.append(front)
        return np.concatenate(found)


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> tuple[list[np.ndarray], int]:
    """All links of all queries, and the beam: where the beam found fewer than the audit counts, the audit's."""
    found = [graph.links(q, beam) for q in queries]
    audited = np.arange(0, len(queries), AUDIT)
    for start in range(0, len(audited), 256):
        part = audited[start:start + 256]
        linked = queries[part] @ graph.x.T >= COSINE
        for k, row, n in zip(part, linked, linked.sum(1), strict=True):
            if len(found[k]) < n:
                found[k] = np.union1d(found[k], np.flatnonzero(row))
    return found, beam


def _united(roots: np.ndarray, a: int) -> int:
    while roots[a] != a:
        roots[a] = roots[roots[a]]
        a = roots[a]
    return a


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fine(v: str) -> Column:
    """Whether a vector (array<double>) and its label can be compared."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def linked(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept and beam of every row."""
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = given.where(_fine("v")).withColumn("node", F.sha2(F.to_json(F.struct("label", "v")).cast("binary"), 256))
    nodes = rows.groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = nodes.withColumn("dim", F.size("v"))
    # A group is a label and a length; its number of shards follows from its number of different vectors.
    shards = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(shard))).cast("int").alias("shards"))
    dealt = cut(nodes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        graph = Graph(_unit(frame["v"]))
        made = pickle.dumps((graph.x, (graph.near, graph.entry, graph.top), frame["node"].tolist(), frame["many"].to_numpy()), protocol=5)
        return pd.DataFrame({"label": frame["label"][:1], "dim": frame["dim"][:1], "shard": frame["shard"][:1], "shards": frame["shards"][:1], "graph": [made]})

    types = dict(dealt.dtypes)
    graphs = cut(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {types['label']}, dim int, shard int, shards int, graph binary"))
    # Every shard's vectors meet every shard's graph.
    asked = dealt.select("label", "dim", "node", "v", F.col("shard").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    offered = graphs.select("label", "dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("block"))

    def query(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"node": [], "links": [], "other": [], "beam": []})
        x, state, names, many = pickle.loads(graph["graph"].iloc[0])
        found, beam = search(Graph(x, state=state), _unit(queries["v"]))
        own = {name: k for k, name in enumerate(names)}
        # Components within the task, over the shard's nodes and the queries from elsewhere.
        n = len(names)
        at = [own.get(name, n + k) for k, name in enumerate(queries["node"])]
        roots = np.arange(n + len(at))
        counts = np.zeros(len(at), np.int64)
        for k, nodes in enumerate(found):
            nodes = nodes[nodes != at[k]]
            counts[k] = many[nodes].sum()
            root = _united(roots, at[k])
            for r in np.unique(roots[nodes]):
                r = _united(roots, int(r))
                if r != root:
                    lower, upper = min(r, root), max(r, root)
                    roots[upper] = lower
                    root = lower
        ends = [_united(roots, a) for a in at]
        # Roots lie among the shard's own nodes wherever a query has a link.
        other = [names[e] if e < n else None for e in ends]
        return pd.DataFrame({"node": queries["node"], "links": counts, "other": other, "beam": beam})

    answers = cut(asked.groupBy("label", "dim", "shard", "block").cogroup(offered.groupBy("label", "dim", "shard", "block"))
                  .applyInPandas(query, "node string, links long, other string, beam int"))
    edges = answers.where(F.col("other").isNotNull() & (F.col("other") != F.col("node"))).select(F.col("node").alias("a"), F.col("other").alias("b"))
    joined = components(edges)
    links = answers.groupBy("node").agg(F.sum("links").alias("links"), F.max("beam").alias("beam"))
    named = dealt.select("node", "first", "many").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = named.join(least, "component").join(links, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "beam")
    known = (rows.select("vec_id", "node").join(by_node, "node")
             .select("vec_id", "n_links", "component_id", "beam"))
    alone = given.where(~_fine("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("int").alias("beam"))
    return (known.unionByName(alone)
            .select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "beam"))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    return linked(vectors).drop("beam")


SQL = """
WITH RECURSIVE given AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT * FROM given
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.rid AS x, b.rid AS y FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT rid AS x, rid AS y FROM given UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS rid, min(vec_id) AS component_id FROM reach JOIN given ON given.rid = reach.y GROUP BY x),
counts AS (SELECT x AS rid, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept
FROM given LEFT JOIN counts USING (rid) LEFT JOIN least USING (rid)
"""
