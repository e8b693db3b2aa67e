"""Second stage: import graph, clusters, blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lintlake.operators import cluster, graph
from lintlake.session import cut


def run(findings: DataFrame, files: DataFrame, alias: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """findings and files(path, content) -> edges, clusters, members, weighed findings."""
    edges = cut(graph.import_edges(files, alias).select("src", "dst"))
    members = (cluster.by_file(findings).unionByName(cluster.by_imports(findings, edges)).unionByName(cluster.by_pattern(findings)))
    parts = cut(cluster.split(cluster.merge(members), findings))
    made = cut(cluster.summary(parts, findings))
    return {"edges": edges, "members": parts, "clusters": made, "stats": cluster.stats(made, parts),
            "findings": graph.with_multiplier(cluster.write_back(findings, parts, made), edges), "blast": graph.blast_radius(edges),
            "unused": graph.unused_files(files.select("path"), edges, [])}


def theme_order(findings: DataFrame) -> DataFrame:
    """Weighed findings, worst first."""
    return findings.orderBy(F.desc("severity_multiplier"), "id")
