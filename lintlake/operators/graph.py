"""Graph jobs over the import graph: edges(src, dst), where src imports dst.

Loops keep their state as tables in the checkpoint folder and stop when a round changes
nothing; what the driver sees of a round is one count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lintlake.catalog import maps as M, rules as R
from lintlake.functions import paths
from lintlake.functions.lookup import first_match, literal_map
from lintlake.functions.rows import beside
from lintlake.operators import skew
from lintlake.operators.ordering import numbered
from lintlake.session import Tables, cut, stored


# --------------------------------------------------------------------- import extraction
def imports(files: DataFrame) -> DataFrame:
    """(path, specifier, names): every module a file imports, with the names it takes from it; with
    ``repo`` first where the files have one."""
    content = F.col("content")
    key = [c for c in ("repo", "path") if c in files.columns]

    def found(pattern, group):
        return F.regexp_extract_all(content, F.lit(pattern), group)

    def pairs(names, specifiers, kind):
        return F.transform(F.arrays_zip(names.alias("n"), specifiers.alias("s")),
                           lambda p: F.struct(p["s"].alias("specifier"), p["n"].alias("names"), F.lit(kind).alias("kind")))

    def bare(specifiers):
        return F.transform(specifiers, lambda s: F.struct(s.alias("specifier"), F.lit("").alias("names"), F.lit("none").alias("kind")))

    everything = F.concat(
        pairs(found(R.IMPORT_NAMED, 1), found(R.IMPORT_NAMED, 2), "named"),
        pairs(found(R.IMPORT_DEFAULT, 1), found(R.IMPORT_DEFAULT, 2), "default"),
        *[bare(found(p, 1)) for p in (R.IMPORT_FROM, R.IMPORT_BARE, R.IMPORT_REQUIRE, R.IMPORT_DYNAMIC, R.IMPORT_REEXPORT)])
    rows = files.select(*key, F.explode(everything).alias("i")).select(*key, "i.*")
    listed = F.filter(F.transform(F.split("names", ","), lambda n: F.trim(F.split(F.trim(n), " as ")[0])), lambda n: n != "")
    taken = (F.when(F.col("kind") == "named", listed)
             .when((F.col("kind") == "default") & (F.col("names") != "type"), F.array("names"))
             .otherwise(F.array().cast("array<string>")))
    # A specifier's names in one file: bounded by that file's text.
    return (rows.withColumn("taken", taken).groupBy(*key, "specifier")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("taken")))).alias("names")))


def aliases(configs: DataFrame) -> DataFrame:
    """tsconfig texts (repo, content) -> (repo, prefix, target) for wildcard path aliases."""
    clean = F.regexp_replace("content", r"//.*", "")
    table = F.from_json(F.get_json_object(clean, "$.compilerOptions.paths"), "map<string,array<string>>")
    base = F.coalesce(F.get_json_object(clean, "$.compilerOptions.baseUrl"), F.lit("."))
    rows = configs.select("repo", base.alias("base"), F.explode(table).alias("pattern", "targets")).where(F.size("targets") > 0)
    target = paths.normal_path(F.concat("base", F.lit("/"), F.replace(F.col("targets")[0], F.lit("*"), F.lit(""))))
    return rows.select("repo", F.replace("pattern", F.lit("*"), F.lit("")).alias("prefix"), F.concat(target, F.lit("/")).alias("target"))


def _bases(wanted: DataFrame, alias: DataFrame) -> DataFrame:
    """Imports with ``base``, the path a specifier means without its extension; null for an outside package.

    A relative specifier starts from the importing file's folder.  Any other is compared with its repo's alias
    prefixes, of which the longest that fits counts; a repo's aliases are one row, as long as its config."""
    listed = alias.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "target")), asc=False).alias("_aliases"))
    near = F.col("specifier").startswith(".")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    inside = wanted.where(near).withColumn("base", F.concat(folder, F.lit("/"), "specifier"))
    outside = skew.join(wanted.where(~near), listed, ["repo"])
    fits = F.filter("_aliases", lambda x: F.col("specifier").startswith(x["prefix"]))
    outside = (outside.withColumn("_fit", F.get(fits, 0)).where(F.col("_fit").isNotNull())
               .withColumn("base", F.concat("_fit.target", F.substring("specifier", F.col("_fit.n") + 1, F.length("specifier")))).drop("_aliases", "_fit"))
    return inside.unionByName(outside).withColumn("base", paths.normal_path(F.col("base")))


def _stems(files: DataFrame) -> DataFrame:
    """(repo, stem, kind, turn, target): by which texts a file can be meant.  Kind 0 is its whole path, 1 the path
    without a known extension, 2 the folder of an index file; ``turn`` is the place of the extension."""
    def named(stem: Column, kind: int, turn: int) -> Column:
        return F.struct(stem.alias("stem"), F.lit(kind).alias("kind"), F.lit(turn).alias("turn"))

    path = F.col("path")
    ways = [named(path, 0, 0)]
    for turn, ext in enumerate(R.IMPORT_EXTENSIONS):
        ways.append(F.when(path.endswith(ext), named(F.substring(path, F.lit(1), F.length(path) - len(ext)), 1, turn)))
        ways.append(F.when(F.concat(F.lit("/"), path).endswith(f"/index{ext}"), named(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), 2, turn)))
    known = files.select("repo", "path").distinct()
    return known.select("repo", path.alias("target"), F.explode(F.array_compact(F.array(*ways))).alias("w")).select("repo", "target", "w.*")


def import_edges(files: DataFrame, alias: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """(src, dst, names), with ``repo`` first where the files have one: which file imports which, one edge per
    pair, none to itself and none between repos.

    ``alias`` is a table (repo, prefix, target) as made by :func:`aliases`, or prefixes that hold everywhere.
    A specifier can mean its base as a whole path, with any extension in place of its own or added, or as a
    folder with an index file, in this order.  So it looks for two stems at most, its base and its base
    without extension, among the stems of the files of its repo, in one join; what it finds is ranked after."""
    scoped = "repo" in files.columns
    files = files if scoped else files.withColumn("repo", F.lit(""))
    if not isinstance(alias, DataFrame):
        rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(t).alias("target")) for p, t in (alias or {}).items()])
        here = files.select("repo").distinct()
        alias = here.select("repo", F.explode(rows).alias("a")).select("repo", "a.*") if alias else here.select("repo", F.lit("").alias("prefix"), F.lit("").alias("target")).limit(0)
    based = _bases(cut(imports(files)), alias).withColumn("_cut", F.regexp_replace("base", r"(?<=[^/.])\.[^./]*$", ""))
    tried = F.array_compact(F.array(F.struct(F.col("base").alias("stem"), F.lit(True).alias("whole")),
                                    F.when(F.col("_cut") != F.col("base"), F.struct(F.col("_cut").alias("stem"), F.lit(False).alias("whole")))))
    tries = cut(based.select("repo", "path", "specifier", "names", F.explode(tried).alias("t")).select("repo", "path", "specifier", "names", "t.*"))
    many = len(R.IMPORT_EXTENSIONS)
    # In place of the extension comes before added to it, for each extension in turn.
    order = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, 2 * F.col("turn") + F.when(F.col("whole"), 2).otherwise(1)).otherwise(2 * many + 1 + F.col("turn"))
    hit = (skew.join(tries, _stems(files), ["repo", "stem"]).where(F.col("whole") | (F.col("kind") == 1))
           .groupBy("repo", "path", "specifier").agg(F.min_by(F.struct("target", "names"), order).alias("best")))
    made = (hit.where(F.col("best.target") != F.col("path"))
            .groupBy("repo", F.col("path").alias("src"), F.col("best.target").alias("dst"))
            .agg(F.min_by("best.names", "specifier").alias("names")))
    return made if scoped else made.drop("repo")


# ------------------------------------------------------------------------- plain measures
def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("total_files"))
    e = edges.agg(F.count(F.lit(1)).alias("total_edges"))
    return beside(n, e).withColumn(
        "avg_imports_per_file", F.when(F.col("total_files") > 0, F.round(F.col("total_edges") / F.col("total_files"), 1)).otherwise(0.0))


def importers(edges: DataFrame) -> DataFrame:
    """(file, importer) rows: the graph seen from the imported side."""
    return edges.select(F.col("dst").alias("file"), F.col("src").alias("importer")).distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    return importers(edges).groupBy("file").agg(F.count(F.lit(1)).alias("importers"))


def unused_files(nodes: DataFrame, edges: DataFrame, entry_points: list[str]) -> DataFrame:
    """Files nobody imports and that are no entry point; within repos where both tables have ``repo``."""
    key = [c for c in ("repo",) if c in nodes.columns and c in edges.columns]
    return (nodes.where(~paths.basename(F.col("path")).isin(entry_points))
            .join(edges.select(*key, F.col("dst").alias("path")), [*key, "path"], "left_anti"))


# ----------------------------------------------------------------------------- components
def components(pairs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Connected components of undirected pairs(a, b): (node, component), the component being its
    smallest node.

    Alternating large-star and small-star rounds: every node hands its smallest neighbour to the
    larger (or smaller) ones, which halves path lengths, so the number of rounds grows with the
    logarithm of the longest chain.  A round is one minimum per node (reduced map-side, so a hub
    is cheap) and one join back.  With ``tables`` the edges of a round replace those of the round
    before in the folder, compressed."""
    def keep(name, frame):
        return tables.put(name, frame) if tables else cut(frame)

    edges = keep("given", pairs.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large-star: neighbours above u point to u's smallest neighbour
        large = (both.where(F.col("v") > F.col("u")).join(smallest, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: u and its neighbours below point to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        edges = keep("edges", small)
        # Done when the edges are stars: each larger end has one edge, and no centre is a larger end.
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(
            edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
        open_ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 OR (up > 0 AND centre > 0)")
        if open_ends.isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


# --------------------------------------------------------------------------- blast radius
HEAVY = 1000


def blast_radius(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Per file: direct importers, importers of those, and all of them together.

    Importers of importers are sets, and a set reached over a file with very many importers, a hub, cannot
    be listed once per edge.  Over other files they are listed.  What a file reaches over hubs depends on which hubs these
    are alone, so it is counted once for each such set of hubs (see :func:`_united`); importers that are listed and also
    reached over a hub count once.  Both ways are exact."""
    direct = stored(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    counts = direct.groupBy("dst").agg(F.count(F.lit(1)).alias("direct"))
    hubs = stored(counts.where(F.col("direct") > heavy).select(F.col("dst").alias("hub"), "direct"))
    light = direct.join(hubs, F.col("dst") == F.col("hub"), "left_anti")
    listed = (light.select("dst", F.col("src").alias("who"))
              .unionByName(direct.join(light.select(F.col("dst").alias("mid"), F.col("src").alias("who")), F.col("src") == F.col("mid"))
                           .where(F.col("who") != F.col("dst")).select("dst", "who")).distinct())
    if hubs.isEmpty():
        found = listed.groupBy("dst").agg(F.count(F.lit(1)).alias("total"))
    else:
        listed = stored(listed)
        into = stored(direct.join(hubs, F.col("dst") == F.col("hub"), "left_semi").select(F.col("src").alias("who"), F.col("dst").alias("hub")))
        # The hubs whose importers a file reaches: those that import it, and itself.
        over = stored(direct.join(hubs, F.col("src") == F.col("hub"), "left_semi").select("dst", F.col("src").alias("hub"))
                      .unionByName(hubs.select(F.col("hub").alias("dst"), "hub")))
        per_file = over.groupBy("dst").agg(F.array_sort(F.collect_list("hub")).alias("hubs"))
        sets = stored(per_file.groupBy("hubs").agg(F.count(F.lit(1)).alias("n")).select("hubs").withColumn("key", F.monotonically_increasing_id()))
        united = per_file.join(sets.join(_united(sets.select("key", F.explode("hubs").alias("hub")), into), "key"), "hubs").select("dst", "total")
        # Listed as well as reached over a hub; a file that reaches itself over one does not count.
        both = (listed.unionByName(over.select("dst", F.col("dst").alias("who")).distinct()).join(over, "dst")
                .join(into, ["who", "hub"], "left_semi").select("dst", "who").distinct())
        found = (listed.select("dst", F.lit(1).alias("n")).unionByName(both.select("dst", F.lit(-1).alias("n")))
                 .groupBy("dst").agg(F.sum("n").alias("total")).unionByName(united).groupBy("dst").agg(F.sum("total").alias("total")))
    return counts.join(found, "dst").select(F.col("dst").alias("file"), F.col("direct").alias("direct_callers"),
                                            (F.col("total") - F.col("direct")).alias("transitive_callers"),
                                            F.col("total").alias("total_affected_files"))


TOGETHER = 4096  # sets of hubs that one task counts at a time


def _united(sets: DataFrame, into: DataFrame) -> DataFrame:
    """(key, total): how many files import one of the hubs of a set; sets(key, hub), into(who, hub).

    Importers are numbered and a hub's are bitmaps of 32,768 files each.  Sets meet the bitmaps of one such block at a
    time, some thousand sets together, so that a bitmap is moved once for those and not once for each set."""
    names = into.select("who").distinct()
    ids = numbered(names, [], [F.col("who")], "id")
    placed = into.join(ids, "who").select("hub", F.expr("bitmap_bucket_number(id)").alias("block"), F.expr("bitmap_bit_position(id)").alias("bit"))
    bitmaps = stored(placed.repartition("block").groupBy("block", "hub").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")))
    parts = sets.select("key").distinct().count() // TOGETHER + 1
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    here = bitmaps.join(dealt.select("part", "hub").distinct(), "hub").select(F.col("block").alias("in_block"), F.col("part").alias("for_part"), "hub", "bits")
    wanted = dealt.join(bitmaps.select("hub", "block"), "hub").select("block", "part", "key", "hub")

    def counted(wanted, here):
        import numpy as np
        import pandas as pd
        bits = np.frombuffer(b"".join(here["bits"]), dtype=np.uint64).reshape(len(here), -1)
        wanted = wanted.assign(at=wanted["hub"].map({hub: at for at, hub in enumerate(here["hub"])})).sort_values("key")
        keys, starts = np.unique(wanted["key"].to_numpy(), return_index=True)
        at = wanted["at"].to_numpy()
        totals = [int(np.bitwise_count(np.bitwise_or.reduce(bits[one], axis=0)).sum()) for one in np.split(at, starts[1:])]
        return pd.DataFrame({"key": keys, "total": totals})

    found = wanted.groupBy("block", "part").cogroup(here.groupBy("in_block", "for_part")).applyInPandas(counted, "key long, total long")
    return found.groupBy("key").agg(F.sum("total").alias("total"))


def multiplier(callers: Column) -> Column:
    """1 to 5 by the number of direct callers."""
    n = F.coalesce(callers, F.lit(0))
    return first_match([(n >= 16, 5), (n >= 8, 4), (n >= 4, 3), (n >= 2, 2)], 1)


def with_multiplier(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """Severity weighed by who imports the file: severity_multiplier, effective_severity."""
    return (findings.join(fan_in(edges), "file", "left")
            .withColumn("direct_callers", F.coalesce("importers", F.lit(0))).drop("importers")
            .withColumn("severity_multiplier", multiplier(F.col("direct_callers")))
            .withColumn("effective_severity", F.concat("severity", F.lit("-x"), F.col("severity_multiplier").cast("string"))))


# --------------------------------------------------------------------- levels and cycles
_ENDLESS = 1 << 40  # the level of what reaches a circle


def levels(edges: DataFrame) -> DataFrame:
    """(file, level): the longest import chain below a file, 0 for one that imports nothing; null for
    files on a cycle or above one.

    Small parts of the graph are settled where they are (see :func:`_apart`), large ones in rounds."""
    def settled(edges):
        import numpy as np
        import pandas as pd
        codes, files = pd.factorize(pd.concat([edges["src"], edges["dst"]]))
        src, dst = np.split(codes, 2)
        up = np.argsort(dst, kind="stable")
        first = np.searchsorted(dst[up], np.arange(len(files) + 1)).tolist()
        above, left = src[up].tolist(), np.bincount(src, minlength=len(files)).tolist()
        level = [0] * len(files)
        done = [file for file, n in enumerate(left) if n == 0]
        for file in done:  # grows as files lose their last open import
            for importer in above[first[file]:first[file + 1]]:
                level[importer] = max(level[importer], level[file] + 1)
                left[importer] -= 1
                if not left[importer]:
                    done.append(importer)
        return pd.DataFrame({"file": files, "level": pd.array([None if n else at for at, n in zip(level, left)], "Int32")})

    small, large = _apart(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found = stored(small.groupBy("group").applyInPandas(settled, "file string, level int"))
    return found if large is None else found.unionByName(_levels(large))


SMALL = 100_000  # imports of a part of the graph that one task takes on


def _apart(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges (src, dst) of a graph's parts that hang together: small parts with a ``group``, of some hundred thousand
    edges, in which each part is whole; and the edges of parts with more than ``SMALL``, None where there are none.

    What a file reaches lies in its part.  So a small part can be solved by one task, and rounds over the whole
    graph are left to parts that are too large for that."""
    tables = Tables(edges.sparkSession)
    edges = tables.put("imports", edges)
    part = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), tables).select(F.col("node").alias("src"), "component")
    edges = tables.put("imports", edges.join(part, "src"))
    sizes = tables.put("sizes", edges.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    found = sizes.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > SMALL).alias("large")).first()
    dealt = edges.withColumn("group", F.pmod(F.xxhash64("component"), F.lit((found["n"] or 0) // SMALL + 1)))
    if not found["large"]:
        return dealt, None
    large = sizes.where(F.col("n") > SMALL)
    return dealt.join(large, "component", "left_anti"), tables.put("large", edges.join(large, "component", "left_semi").select("src", "dst"))


def _levels(edges: DataFrame) -> DataFrame:
    """Levels of a graph of any form.

    An edge carries the length of the path it stands for, a file the longest path found below it so far.  A round does
    two things at once: files without open edges are settled and hand their level up, and an edge to a file with one open
    edge goes on to where that one leads (lengths add up, what the file knows of below it is handed up).
    So a chain halves in every round, and of edges between the same files only the longest stays.  A path as long as there
    are files has been round a circle; when no edge leads to a file that is settled or passed over, all that is left
    lies on circles or above them.  Lists of importers are never gathered; a round writes one table of files and
    one of edges, and counts while it writes."""
    tables = Tables(edges.sparkSession)
    # Edges (src, dst, w): ``open`` ones still count, ``up`` is what src has learnt of the path below it.
    step = tables.put("step", edges.where(F.col("src") != F.col("dst")).select("src", "dst", F.lit(1).cast("long").alias("w"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("up")).distinct())
    files = step.select(F.col("src").alias("file")).unionByName(step.select(F.col("dst").alias("file"))).distinct()
    waiting = tables.put("files", files.withColumn("low", F.lit(0).cast("long")))
    n = waiting.count()
    settled = waiting.limit(0)
    rounds = 0
    while True:
        out = step.groupBy("src").agg(F.count_if("open").alias("n"), F.max(F.when(F.col("open"), F.struct("dst", "w"))).alias("one"), F.max("up").alias("up"))
        low = F.greatest("low", "up")
        state = tables.put("state", waiting.join(out, waiting["file"] == out["src"], "left")
                           .select("file", low.alias("low"), ((F.coalesce("n", F.lit(0)) == 0) | (low >= _ENDLESS)).alias("done"),
                                   F.when(F.col("n") == 1, F.col("one.dst")).alias("next"), F.col("one.w").alias("further")))
        rounds += 1
        settled = settled.unionByName(tables.put(f"done{rounds}", state.where("done").select("file", "low")))
        if rounds % 8 == 0:  # keep the plan short on deep graphs
            settled = tables.put("settled", settled)
        waiting = state.where("NOT done").select("file", "low")
        # An edge can have been passed on to a file that was settled in that very round.
        known = state.where("NOT done").unionByName(settled.withColumn("done", F.lit(True)), allowMissingColumns=True)
        below = known.select(F.col("file").alias("dst"), "low", "done", "next", "further")
        over = ~F.col("done") & F.col("next").isNotNull()
        to, far = F.when(over, F.col("next")).otherwise(F.col("dst")), F.col("w") + F.when(over, F.col("further")).otherwise(0)
        up = (F.when(over & ((to == F.col("src")) | (far >= n)), _ENDLESS).when(F.col("done") | over, F.least(F.col("w") + F.col("low"), F.lit(_ENDLESS))).otherwise(0))
        # Files that are settled as endless have edges left that no longer matter.
        moved = (step.where("open").join(waiting.select(F.col("file").alias("src")), "src", "left_semi").join(below, "dst")
                 .select("src", to.alias("dst"), far.alias("w"), (~F.col("done") & (to != F.col("src"))).alias("open"), up.alias("up"), (F.col("done") | over).alias("moved")))
        seen = Observation()
        merged = moved.groupBy("src", "dst", "open").agg(F.max("w").alias("w"), F.max("up").alias("up"), F.max("moved").alias("moved"))
        step = tables.put("step", merged.observe(seen, F.count_if("moved").alias("moved")).select("src", "dst", "w", "open", "up"))
        if not seen.get["moved"]:
            break
    settled = settled.unionByName(waiting.select("file", F.lit(_ENDLESS).alias("low")))
    return settled.select("file", F.when(F.col("low") < _ENDLESS, F.col("low").cast("int")).alias("level"))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label along the edges, to a fixpoint: labels(node, label), edges(src, dst)."""
    while True:
        moved = edges.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("new"))
        after = cut(labels.join(moved, F.col("node") == F.col("dst"), "left")
                    .select("node", F.least("label", F.coalesce("new", "label")).alias("label"),
                            (F.coalesce("new", "label") < F.col("label")).alias("changed")))
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


def _degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, before, behind): the last two are the one neighbour where there is one."""
    ends = edges.select(F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(None).cast("string").alias("behind")).unionByName(
        edges.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("before"), F.col("dst").alias("behind")))
    return ends.groupBy("node").agg(F.count("before").alias("n_in"), F.count("behind").alias("n_out"), F.max("before").alias("before"), F.max("behind").alias("behind"))


def _chains(between: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with one way in and one way out, between(node, before, behind), as (node, left, right), the files at which their
    chain begins and ends, and those of closed rings as (node, cycle).

    Pointers to both sides double their reach in every round; in a ring they never end."""
    now = between.select("node", F.col("before").alias("left"), F.col("behind").alias("right"), F.least("node", "behind").alias("low"))
    tables = Tables(between.sparkSession)
    now = tables.put("now", now.withColumn("l_open", F.lit(True)).withColumn("r_open", F.lit(True)))
    rounds = max(now.count(), 1).bit_length() + 1
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("right"), F.col("right").alias("right2"), F.col("low").alias("low2"))
        behind = now.select(F.col("node").alias("left"), F.col("left").alias("left2"))
        now = tables.put("now", now.join(ahead, "right", "left").join(behind, "left", "left")
                  .select("node", F.coalesce("left2", "left").alias("left"), F.coalesce("right2", "right").alias("right"),
                          F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("left2").isNotNull().alias("l_open"), F.col("right2").isNotNull().alias("r_open")))
        if now.where("l_open OR r_open").isEmpty():
            break
    closed = F.col("l_open") & F.col("r_open")
    return now.where(~closed).select("node", "left", "right"), now.where(closed).select("node", F.col("low").alias("cycle"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, cycle) of a graph by colours: each node takes the smallest node that reaches it; those that reach that node
    back, within the same colour, form one group and leave; the rest goes another round."""
    left, found = edges, None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(cut(nodes.withColumn("label", F.col("node"))), left)
        # Walk the edges backwards from each colour's own node, inside the colour.
        inside = cut(left.join(colour.withColumnsRenamed({"node": "src", "label": "c1"}), "src")
                     .join(colour.withColumnsRenamed({"node": "dst", "label": "c2"}), "dst")
                     .where(F.col("c1") == F.col("c2")).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = cut(colour.where(F.col("node") == F.col("label")))
        while True:
            more = cut(inside.join(reached.select(F.col("node").alias("src"), "label"), "src")
                       .select(F.col("dst").alias("node"), "label").distinct().join(reached, "node", "left_anti"))
            if more.isEmpty():
                break
            reached = cut(reached.unionByName(more))
        sizes = reached.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        group = reached.join(sizes, "label", "left_semi").select("node", F.col("label").alias("cycle"))
        found = group if found is None else found.unionByName(group)
        gone = reached.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
                   .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """(file, cycle): files that import each other in a circle, named by the smallest of them.

    Small parts of the graph are searched where they are (see :func:`_apart`), large ones in rounds."""
    def circles(edges):
        """Tarjan's search, without recursion."""
        import numpy as np
        import pandas as pd
        codes, files = pd.factorize(pd.concat([edges["src"], edges["dst"]]))
        src, dst = np.split(codes, 2)
        down = np.argsort(src, kind="stable")
        first = np.searchsorted(src[down], np.arange(len(files) + 1)).tolist()
        below = dst[down].tolist()
        seen, low, at = [0] * len(files), [0] * len(files), first[:]  # when a file was met, the earliest it reaches, its next edge
        pending, met, found = [], 0, []
        for start in range(len(files)):
            path = [start] if not seen[start] else []
            while path:
                file = path[-1]
                if not seen[file]:
                    met += 1
                    seen[file] = low[file] = met
                    pending.append(file)
                if at[file] < first[file + 1]:
                    to = below[at[file]]
                    at[file] += 1
                    if not seen[to]:
                        path.append(to)
                    elif low[to]:  # not yet part of a circle that is closed
                        low[file] = min(low[file], seen[to])
                    continue
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[file])
                if low[file] == seen[file]:
                    circle = []
                    while low[file]:
                        circle.append(pending.pop())
                        low[circle[-1]] = 0
                    if len(circle) > 1:
                        name = min(files[one] for one in circle)
                        found += [(files[one], name) for one in circle]
        return pd.DataFrame(found, columns=["file", "cycle"])

    small, large = _apart(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found = stored(small.groupBy("group").applyInPandas(circles, "file string, cycle string"))
    return found if large is None else found.unionByName(_cycles(large))


def _cycles(edges: DataFrame) -> DataFrame:
    """Circles of a graph of any form.

    The graph is shrunk first.  Files without a way in or out go; chains of files with one way in and one way out become one
    edge, found by pointers that double their reach, so a chain or ring of any length takes a logarithmic number of
    rounds.  What is left is coloured from many starts at once.  Then chains come back, last ones first: their files
    are on a circle if both ends of the chain are on the same one, or if it leads back to where it began."""
    tables = Tables(edges.sparkSession)
    left = tables.put("left", edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    taken = []
    while True:
        degrees = tables.put("degrees", _degrees(left))
        dead = degrees.where("n_in = 0 OR n_out = 0").select("node")
        between = degrees.where("n_in = 1 AND n_out = 1").select("node", "before", "behind")
        sizes = degrees.agg(F.count_if(F.expr("n_in = 0 OR n_out = 0")).alias("dead"), F.count_if(F.expr("n_in = 1 AND n_out = 1")).alias("between")).first()
        if sizes["between"]:
            chains, rings = _chains(between)
            chains = tables.put(f"chains{len(taken)}", chains)
            rings = tables.put(f"rings{len(taken)}", rings)
            # A chain that comes back to its own start: that file is on a circle, whatever else it is part of.
            loops = chains.where(F.col("left") == F.col("right")).select(F.col("left").alias("node"), F.col("left").alias("cycle")).distinct()
            taken.append((chains, loops))
            found = found.unionByName(rings)
            gone = between.select("node")
            kept = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            left = tables.put("left", kept.unionByName(chains.where(F.col("left") != F.col("right")).select(F.col("left").alias("src"), F.col("right").alias("dst"))).distinct())
        elif sizes["dead"]:
            left = tables.put("left", left.join(dead.withColumnRenamed("node", "src"), "src", "left_anti").join(dead.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        else:
            break
    core = _coloured(left)
    found = tables.put("found", found if core is None else found.unionByName(core))
    for chains, loops in reversed(taken):
        found = found.unionByName(loops.join(found.select("node"), "node", "left_anti"))
        ends = [found.select(F.col("node").alias(side), F.col("cycle").alias(f"{side}_cycle")) for side in ("left", "right")]
        back = chains.join(ends[0], "left").join(ends[1], "right").where(F.col("left_cycle") == F.col("right_cycle")).select("node", F.col("left_cycle").alias("cycle"))
        found = tables.put("found", found.unionByName(back))
    named = found.groupBy("cycle").agg(F.min("node").alias("name"))
    return found.join(named, "cycle").select(F.col("node").alias("file"), F.col("name").alias("cycle"))


# -------------------------------------------------------------------------------- phases
def phase_nodes(findings: DataFrame) -> DataFrame:
    """All phases with their names and finding counts."""
    spark = findings.sparkSession
    phases = spark.range(len(M.PHASE_NAME)).select(F.col("id").cast("int").alias("phase"))
    counts = findings.where(F.col("phase").between(0, M.LAST_PHASE)).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return phases.join(counts, "phase", "left").select(
        "phase", literal_map(M.PHASE_NAME)[F.col("phase")].alias("name"), F.coalesce("n", F.lit(0)).alias("finding_count"))


def phase_prerequisites(spark) -> DataFrame:
    """(phase, prerequisite) rows of the fixed phase graph."""
    pairs = F.array(*[F.struct(F.lit(b).alias("phase"), F.lit(a).alias("prerequisite")) for a, b in M.PHASE_EDGES])
    return spark.range(1).select(F.explode(pairs).alias("e")).select("e.phase", "e.prerequisite")


def fix_order(findings: DataFrame, edges: DataFrame, rank: Column) -> DataFrame:
    """Findings in the order to fix them: phase, then files further down the import chain first,
    then severity, one file's findings together.  ``circular`` marks files whose level is undefined."""
    edges = stored(edges)
    below = levels(edges)
    itself = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("file")).distinct().join(below, "file", "left_anti")
    known = below.unionByName(itself.withColumn("level", F.lit(None).cast("int"))).withColumn("_in", F.lit(True))
    placed = (findings.join(known, "file", "left")
              .withColumn("circular", F.col("_in").isNotNull() & F.col("level").isNull())
              .withColumn("level", F.coalesce("level", F.lit(0))).drop("_in").withColumn("_rank", rank))
    order = [F.col(c) for c in ("phase", "level", "_rank", "file", "line", "id")]
    # Stored, as numbering reads its input twice.
    return numbered(stored(placed), [], order, "position").drop("_rank")
