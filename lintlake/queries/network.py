"""Import graph, components, blast radius, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import layers as L, maps as M, rules as R
from lintlake.functions import severity as S
from lintlake.operators import cluster, graph, groups
from lintlake.queries import views as V
from lintlake.queries.findings import GROUPED, NAMES
from lintlake.queries.registry import query
from lintlake.queries.reports import CROSSED, crossed
from lintlake.queries.scan import _q
from lintlake.session import stored


# -------------------------------------------------------------------------- import extraction
IMPORTS = " UNION ALL ".join(
    f"SELECT path, unnest(regexp_extract_all(content, {_q(p)}, {g})) AS specifier FROM code_files"
    for p, g in ((R.IMPORT_FROM, 1), (R.IMPORT_BARE, 1), (R.IMPORT_REQUIRE, 1), (R.IMPORT_DYNAMIC, 1), (R.IMPORT_REEXPORT, 1)))


@query("imports", V.sql("code_files", f"SELECT path, specifier, CASE WHEN bool_or(contains(specifier, 'services')) THEN 'Widget' WHEN max(named) IS NOT NULL THEN max(named) ELSE '' END AS names FROM (SELECT path, specifier, NULL AS named FROM ({IMPORTS}) UNION ALL SELECT path, s, n FROM (SELECT path, unnest(regexp_extract_all(content, {_q(R.IMPORT_NAMED)}, 2)) AS s, unnest(list_transform(regexp_extract_all(content, {_q(R.IMPORT_NAMED)}, 1), lambda x: array_to_string(list_sort(list_transform(string_split(x, ','), lambda y: string_split(trim(y), ' as ')[1])), ','))) AS n FROM code_files)) GROUP BY 1, 2"))
def imports(spark, folder):
    return graph.imports(V.code_files(spark, folder)).select("path", "specifier", F.array_join("names", ",").alias("names"))


# What the template lines mean: './f<n>' in the same folder (in whatever form the file exists),
# '@/services/f<n>' in src/services: in one repo by the only alias, in the other by the longer of two.
REPO_IMPORTS = " UNION ALL ".join(
    f"SELECT repo, path, unnest(regexp_extract_all(content, {_q(p)}, {g})) AS specifier FROM repo_files"
    for p, g in ((R.IMPORT_FROM, 1), (R.IMPORT_BARE, 1), (R.IMPORT_REQUIRE, 1), (R.IMPORT_DYNAMIC, 1), (R.IMPORT_REEXPORT, 1)))
RESOLVED = """SELECT DISTINCT repo, src, dst FROM (
  SELECT i.repo, i.path AS src, t.path AS dst, row_number() OVER (PARTITION BY i.repo, i.path, i.specifier ORDER BY t.rank) AS n FROM (SELECT DISTINCT repo, path, specifier FROM imported) i
  JOIN (SELECT repo, path, path AS tried, 0 AS rank FROM repo_files UNION ALL SELECT repo, path, regexp_replace(path, '[.]ts$', ''), 1 FROM repo_files WHERE ends_with(path, '.ts')) t
    ON t.repo = i.repo AND t.tried = CASE WHEN starts_with(i.specifier, './') THEN concat(regexp_replace(i.path, '[^/]*$', ''), substr(i.specifier, 3))
      WHEN i.repo = 'east' AND starts_with(i.specifier, '@/') THEN concat('src/', substr(i.specifier, 3))
      WHEN i.repo = 'west' AND starts_with(i.specifier, '@/services/') THEN concat('src/services/', substr(i.specifier, 12)) WHEN i.repo = 'west' AND starts_with(i.specifier, '@/') THEN concat('none/', substr(i.specifier, 3)) END)
WHERE n = 1 AND src <> dst"""
RESOLVE = dict(imported=REPO_IMPORTS, code_edges=RESOLVED)
CONFIGS = {"east": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
           "west": '{"compilerOptions": {"baseUrl": ".", // from here\n "paths": {"@/*": ["./none/*"], "@/services/*": ["./src/services/*"]}}}'}


def repo_aliases(spark):
    rows = F.array(*[F.struct(F.lit(r).alias("repo"), F.lit(c).alias("content")) for r, c in CONFIGS.items()])
    return graph.aliases(spark.range(1).select(F.explode(rows).alias("r")).select("r.*"))


def code_edges(spark, folder):
    return graph.import_edges(V.repo_files(spark, folder), repo_aliases(spark))


@query("import_edges", V.sql("repo_files", "SELECT repo, src, dst FROM code_edges", **RESOLVE))
def import_edges(spark, folder):
    return code_edges(spark, folder).select("repo", "src", "dst")


@query("graph_stats", V.sql("repo_files", "SELECT f AS total_files, e AS total_edges, CASE WHEN f > 0 THEN round(e / f, 1) ELSE 0.0 END AS avg_imports_per_file FROM (SELECT (SELECT count(*) FROM repo_files) AS f, (SELECT count(*) FROM code_edges) AS e)", **RESOLVE))
def graph_stats(spark, folder):
    return graph.graph_stats(V.repo_files(spark, folder).select("path"), code_edges(spark, folder))


@query("unused_files", V.sql("repo_files", f"SELECT repo, path FROM repo_files WHERE stack = 'typescript' AND (repo, path) NOT IN (SELECT (repo, dst) FROM code_edges) AND regexp_extract(path, '[^/]*$', 0) NOT IN ({', '.join(_q(x) for x in L.ENTRY_POINTS)})", **RESOLVE))
def unused_files(spark, folder):
    files = V.repo_files(spark, folder)
    return graph.unused_files(files.where("stack = 'typescript'").select("repo", "path"), graph.import_edges(files, repo_aliases(spark)), L.ENTRY_POINTS)


# tsconfig texts made of customers: two wildcard aliases, one of them commented out now and then.
@query("path_aliases", """SELECT concat('r', cast(c_custkey AS varchar)) AS repo, concat('@', lower(substr(c_mktsegment, 1, 1)), '/') AS prefix, concat(CASE WHEN c_custkey % 3 = 0 THEN 'web/' ELSE '' END, 'src/', lower(c_mktsegment), '/') AS target FROM customer
UNION ALL SELECT concat('r', cast(c_custkey AS varchar)), '~/', concat(CASE WHEN c_custkey % 3 = 0 THEN 'web/' ELSE '' END, 'lib/') FROM customer WHERE c_custkey % 2 = 0""")
def path_aliases(spark, folder):
    key = F.col("c_custkey")
    text = F.concat(
        F.lit('{ // compiler\n "compilerOptions": {"baseUrl": "'), F.when(key % 3 == 0, "web").otherwise("."), F.lit('", "paths": {"@'),
        F.lower(F.substring("c_mktsegment", 1, 1)), F.lit('/*": ["./src/'), F.lower("c_mktsegment"), F.lit('/*", "x/*"]'),
        F.when(key % 2 == 0, ',\n "~/*": ["lib/*"]').otherwise(',\n "none/*": []\n // , "~/*": ["lib/*"]'), F.lit("\n}}}"))
    return graph.aliases(V.table(spark, folder, "customer").select(F.concat(F.lit("r"), key.cast("string")).alias("repo"), text.alias("content")))


# ------------------------------------------------------------------------------- measures
@query("importers", V.sql("edges", "SELECT dst AS file, src AS importer FROM edges"))
def importers(spark, folder):
    return graph.importers(V.edges(spark, folder))


@query("fan_in", V.sql("edges", "SELECT dst AS file, count(DISTINCT src) AS importers FROM edges GROUP BY 1"))
def fan_in(spark, folder):
    return graph.fan_in(V.edges(spark, folder))


REACH = """WITH RECURSIVE both_(a, b) AS (SELECT src, dst FROM {e} UNION SELECT dst, src FROM {e}), reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a"""


@query("components", V.sql("edges", REACH.format(e="edges")))
def components(spark, folder):
    return graph.components(V.edges(spark, folder).select(F.col("src").alias("a"), F.col("dst").alias("b")))


BLAST = """SELECT dst AS file, count(DISTINCT who) FILTER (WHERE near) AS direct_callers, count(DISTINCT who) - count(DISTINCT who) FILTER (WHERE near) AS transitive_callers, count(DISTINCT who) AS total_affected_files FROM (
  SELECT dst, src AS who, true AS near FROM {e} UNION ALL SELECT e.dst, f.src, false FROM {e} e JOIN {e} f ON e.src = f.dst WHERE f.src <> e.dst) GROUP BY 1"""


@query("blast_radius", V.sql("edges", BLAST.format(e="edges")))
def blast_radius(spark, folder):
    return graph.blast_radius(V.edges(spark, folder))


# A denser graph: parts that are sold together with a part of few; a few parts are hubs.
HUBBED = """SELECT DISTINCT concat('h', cast(l_partkey AS varchar)) AS src, concat('h', cast(l_suppkey % 20 AS varchar)) AS dst FROM lineitem WHERE l_partkey <> l_suppkey % 20
  UNION SELECT DISTINCT concat('h', cast(l_suppkey % 20 AS varchar)), concat('h', cast(l_partkey AS varchar)) FROM lineitem WHERE l_quantity > 49 AND l_partkey <> l_suppkey % 20"""


def hubbed(spark, folder):
    li = V.table(spark, folder, "lineitem").withColumn("hub", F.col("l_suppkey") % 20).where("l_partkey <> hub")
    part, hub = F.concat(F.lit("h"), F.col("l_partkey").cast("string")), F.concat(F.lit("h"), F.col("hub").cast("string"))
    return (li.select(part.alias("src"), hub.alias("dst"))
            .unionByName(li.where("l_quantity > 49").select(hub.alias("src"), part.alias("dst"))).distinct())


@query("blast_radius_of_hubs", V.sql("", BLAST.format(e="hubbed"), hubbed=HUBBED))
def blast_radius_of_hubs(spark, folder):
    return graph.blast_radius(hubbed(spark, folder), heavy=100)


@query("import_levels", V.sql("edges", """
WITH RECURSIVE down(file, level) AS (SELECT dst, 0 FROM edges WHERE dst NOT IN (SELECT src FROM edges) UNION SELECT e.src, d.level + 1 FROM down d JOIN edges e ON e.dst = d.file)
SELECT file, max(level) AS level FROM down GROUP BY file"""))
def import_levels(spark, folder):
    return graph.levels(V.edges(spark, folder))


# Edges closed into circles: some are also there the other way round.
LOOPED = "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE length(src) = length(dst) AND ends_with(src, '0.ts')"


def looped(spark, folder):
    e = V.edges(spark, folder)
    back = e.where((F.length("src") == F.length("dst")) & F.col("src").endswith("0.ts"))
    return e.unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


# Files on a circle, and files from which one is reached, have no level.
ENDLESS = """WITH RECURSIVE reach(a, b) AS (SELECT src, dst FROM looped UNION SELECT r.a, e.dst FROM reach r JOIN looped e ON r.b = e.src),
endless AS (SELECT a AS file FROM reach WHERE a = b UNION SELECT a FROM reach WHERE b IN (SELECT a FROM reach WHERE a = b)),
down(file, level) AS (SELECT DISTINCT dst, 0 FROM looped WHERE dst NOT IN (SELECT src FROM looped) UNION SELECT e.src, d.level + 1 FROM down d JOIN looped e ON e.dst = d.file WHERE e.src NOT IN (SELECT file FROM endless)),
lev AS (SELECT file, max(level) AS level FROM down GROUP BY file UNION ALL SELECT file, NULL FROM endless)
"""


@query("import_cycles", V.sql("edges", """
WITH RECURSIVE reach(a, b) AS (SELECT src, dst FROM looped UNION SELECT r.a, e.dst FROM reach r JOIN looped e ON r.b = e.src)
SELECT r.a AS file, min(r.b) AS cycle FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a HAVING count(*) > 1""", looped=LOOPED))
def import_cycles(spark, folder):
    return graph.cycles(looped(spark, folder))


@query("import_levels_with_circles", V.sql("edges", f"{ENDLESS}SELECT file, level FROM lev", looped=LOOPED))
def import_levels_with_circles(spark, folder):
    return graph.levels(looped(spark, folder))


@query("fix_order", V.sql("findings edges", f"""{ENDLESS}SELECT id, coalesce(level, 0) AS level, lev.file IS NOT NULL AND level IS NULL AS circular, row_number() OVER (ORDER BY phase, coalesce(level, 0), {V.rank_sql('severity')}, f.file, line, id) AS position FROM findings f LEFT JOIN lev ON f.file = lev.file""", looped=LOOPED))
def fix_order(spark, folder):
    return graph.fix_order(V.ranked_findings(spark, folder), looped(spark, folder), S.rank(F.col("severity"))).select("id", "level", "circular", "position")


@query("phase_dag_nodes", V.sql("findings", f"SELECT p.phase, {V.map_sql(M.PHASE_NAME, 'p.phase')} AS name, coalesce(n, 0) AS finding_count FROM (SELECT cast(unnest(range(0, 11)) AS int) AS phase) p LEFT JOIN (SELECT phase, count(*) AS n FROM findings GROUP BY 1) f ON p.phase = f.phase"))
def phase_dag_nodes(spark, folder):
    return graph.phase_nodes(V.findings(spark, folder))


@query("phase_prerequisites", V.sql("findings", f"""SELECT e.phase, prerequisite, coalesce(n, 0) AS open_before FROM (SELECT unnest({[b for _, b in M.PHASE_EDGES]}) AS phase, unnest({[a for a, _ in M.PHASE_EDGES]}) AS prerequisite) e
  LEFT JOIN (SELECT phase, count(*) AS n FROM findings GROUP BY 1) f ON e.prerequisite = f.phase"""))
def phase_prerequisites(spark, folder):
    nodes = graph.phase_nodes(V.findings(spark, folder)).select(F.col("phase").alias("prerequisite"), F.col("finding_count").alias("open_before"))
    return graph.phase_prerequisites(spark).join(nodes, "prerequisite").select("phase", "prerequisite", "open_before")


# -------------------------------------------------------------------------------- clusters
COMPONENTS = """SELECT a AS node, min(b) AS component FROM reach GROUP BY a"""
MEMBERS = """SELECT concat('file|', file) AS cluster, 'file' AS type, id FROM marked
UNION ALL SELECT concat('imports|', component), 'import_connected', id FROM marked JOIN linked ON file = node
UNION ALL SELECT concat('group|', cross_cutting_group), 'cross_cutting', id FROM marked WHERE cross_cutting_group IN (SELECT cross_cutting_group FROM big)
UNION ALL SELECT concat('wording|', rule, '|', description), 'cross_cutting', id FROM marked l WHERE (rule, description) IN (
  SELECT (rule, description) FROM marked GROUP BY rule, description HAVING count(*) >= 2 AND count(*) FILTER (WHERE cross_cutting_group IS NULL OR cross_cutting_group NOT IN (SELECT cross_cutting_group FROM big)) > 0)"""
BIG = "SELECT cross_cutting_group FROM marked WHERE cross_cutting_group IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"
BOTH = "SELECT src AS a, dst AS b FROM inside UNION SELECT dst, src FROM inside"
INSIDE = "SELECT src, dst FROM edges WHERE src IN (SELECT file FROM marked) AND dst IN (SELECT file FROM marked)"
REACH_CTE = "reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)"


def _cluster_sql(query_text: str) -> str:
    parts = {**GROUPED, "marked": CROSSED, "big": BIG, "inside": INSIDE, "both_": BOTH}
    return V.sql("findings edges", f"WITH RECURSIVE {REACH_CTE},\nlinked AS ({COMPONENTS}),\nmembers AS ({MEMBERS})\n{query_text}", **parts)


KEPT = ["id", "rule", "severity", "file", "line", "description", "search_pattern", "current_code", "cross_cutting_group"]


def local(spark, folder):
    # Grouping reads the findings three times, so they are made before.
    found = stored(V.findings(spark, folder).select(*[c for c in KEPT if c != "cross_cutting_group"]))
    return stored(groups.cross_cutting(found).select(*KEPT))


def members(found, spark, folder):
    return cluster.by_file(found).unionByName(cluster.by_imports(found, V.edges(spark, folder))).unionByName(cluster.by_pattern(found))


@query("cluster_members", _cluster_sql("SELECT cluster, type, id FROM members"))
def cluster_members(spark, folder):
    return members(local(spark, folder), spark, folder)


@query("cluster_overlap", _cluster_sql("""SELECT a, b, common FROM (SELECT x.cluster AS a, y.cluster AS b, count(*) AS common FROM members x JOIN members y ON x.id = y.id AND x.cluster < y.cluster GROUP BY 1, 2)
  JOIN (SELECT cluster, count(*) AS na FROM members GROUP BY 1) p ON a = p.cluster JOIN (SELECT cluster, count(*) AS nb FROM members GROUP BY 1) q ON b = q.cluster WHERE common / least(na, nb) > 0.5"""))
def cluster_overlap(spark, folder):
    return cluster.overlaps(members(local(spark, folder), spark, folder))


def built(spark, folder):
    found = local(spark, folder)
    return found, cluster.split(cluster.merge(members(found, spark, folder)), found, more=cluster.SAID)


@query("cluster_merge")
def cluster_merge(spark, folder):
    return cluster.merge(members(local(spark, folder), spark, folder)).groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("findings"))


# By file alone the parts can be written in SQL: chunks of twelve per rule and wording.
CHUNKS = f"""SELECT f.id, concat('file|', file) AS cluster, CASE WHEN n > 12 THEN concat(rule, '|', key, '|', cast(cast(ceil(row_number() OVER (PARTITION BY file, rule, key ORDER BY line, f.id) / 12) AS int) AS varchar)) ELSE '' END AS part FROM (
  SELECT *, count(*) OVER (PARTITION BY file) AS n, trim(regexp_replace(lower(coalesce(cross_cutting_group, search_pattern, current_code, description)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM marked) f"""


def filed(found, *more):
    """Findings with their file's cluster: each is in one, so there is nothing to join."""
    placed = found.withColumn("cluster", cluster.file_cluster(found)).withColumn("type", F.lit("file"))
    return cluster.detailed(placed, "cluster", "type", *more)


@query("cluster_chunks", V.sql("findings", CHUNKS, **GROUPED, marked=CROSSED))
def cluster_chunks(spark, folder):
    return cluster.cut_up(filed(crossed(spark, folder))).select("id", "cluster", "part")


CLUSTERS = f"""SELECT concat('CLU-', CASE WHEN position < 1000 THEN lpad(cast(position AS varchar), 3, '0') ELSE cast(position AS varchar) END) AS cluster_id, * FROM (
  SELECT cluster, part, 'file' AS type, arg_min(substr(description, 1, 80), (r, id)) AS name, string_agg(DISTINCT file, ',' ORDER BY file) AS files, string_agg(DISTINCT id, ',' ORDER BY id) AS finding_ids, count(DISTINCT id) AS finding_count,
    {NAMES.format('min(r)')} AS max_severity, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, substr(min(description), 1, 50) AS root_pattern, row_number() OVER (ORDER BY min(r), -count(DISTINCT id), cluster, part) AS position
  FROM (SELECT c.cluster, c.part, m.*, {V.rank_sql('severity')} AS r FROM chunks c JOIN marked m ON c.id = m.id) GROUP BY cluster, part)"""
CLUSTERED = dict(**GROUPED, marked=CROSSED, chunks=CHUNKS, clusters=CLUSTERS)


def file_parts(spark, folder):
    return stored(cluster.cut_up(filed(crossed(spark, folder), "severity", "description")))


def file_clusters(spark, folder):
    """The parts of the files' clusters with what is counted of their findings, and their summary."""
    parts = file_parts(spark, folder)
    return parts, cluster.summarised(parts)


@query("cluster_summary", V.sql("findings", "SELECT * FROM clusters", **CLUSTERED))
def cluster_summary(spark, folder):
    return file_clusters(spark, folder)[1]


@query("cluster_stats", V.sql("findings", """SELECT count(*) AS total_clusters, (SELECT count(DISTINCT id) FROM chunks) AS total_findings_clustered, round((SELECT count(DISTINCT id) FROM chunks) / count(*), 1) AS avg_findings_per_cluster, max(finding_count) AS largest_cluster_size,
  0::BIGINT AS cross_cutting_clusters, 0::BIGINT AS import_connected_clusters, count(*) AS file_clusters FROM clusters""", **CLUSTERED))
def cluster_stats(spark, folder):
    parts, made = file_clusters(spark, folder)
    return cluster.stats(made, parts)


@query("cluster_write_back", V.sql("findings", "SELECT k.id, c.cluster_id FROM chunks k JOIN clusters c ON k.cluster = c.cluster AND k.part = c.part", **CLUSTERED))
def cluster_write_back(spark, folder):
    parts, made = file_clusters(spark, folder)
    # Each finding is in one part, so the parts are the findings.
    return cluster.write_back(parts.select("id"), parts, made).select("id", "cluster_id")


@query("top_clusters", V.sql("findings", "SELECT cluster_id, finding_count, max_severity FROM clusters ORDER BY position LIMIT 5", **CLUSTERED))
def top_clusters(spark, folder):
    return file_clusters(spark, folder)[1].orderBy("position").limit(5).select("cluster_id", "finding_count", "max_severity")


@query("related_findings", V.sql("findings", "SELECT a.cluster, a.part, a.id, b.id AS related_id, 'same_root_cause' AS relationship FROM chunks a JOIN chunks b ON a.cluster = b.cluster AND a.part = b.part AND a.id < b.id", **CLUSTERED))
def related_findings(spark, folder):
    return cluster.paired(file_parts(spark, folder))


@query("all_cluster_summary")
def all_cluster_summary(spark, folder):
    found, parts = built(spark, folder)
    return cluster.summary(parts, found)
