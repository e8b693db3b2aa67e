"""Every query of the subpackage: against its oracle SQL, on empty tables, with extra and clashing columns."""

import duckdb
import pytest

from lintlake.llm import queries as llm
from lintlake.llm import align, bagminhash, chat, decontaminate, extract, hnsw, licences, likelihood, mixing, quality, resample, secret_links, warc
from lintlake.llm.common import table
from tools.check_oracle import TABLES, canonical


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracle(spark, folder, duck, name):
    frame = llm.QUERIES[name](spark, folder)
    result = duck.execute(llm.ORACLES[name])
    want = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == want


def runs(spark, folder):
    """Operator name -> (table, function over that table)."""
    given = lambda name: table(spark, folder, name)
    return {
        "op1": ("pages", warc.report), "op2": ("embeddings", hnsw.report), "op3": ("documents", secret_links.scan), "op4": ("pages", extract.extract),
        "op5": ("documents", bagminhash.report), "op6": ("conversations", lambda t: chat.report(chat.typed(t))),
        "op7": ("documents", lambda t: decontaminate.report(t, given("benchmark"))), "op8": ("documents", licences.scan),
        "op9": ("documents", lambda t: quality.classified(t, given("labels"))), "op10": ("documents", mixing.report),
        "op11": ("documents", lambda t: likelihood.report(t, given("labels"))), "op12": ("documents", align.report),
        "op13": ("documents", lambda t: resample.report(t, given("benchmark")))}


NAMES = [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, folder, name):
    source, run = runs(spark, folder)[name]
    rows = run(table(spark, folder, source).limit(0)).collect()
    assert len(rows) == (1 if name == "op6" else 0)  # conversation -7 is always there


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_and_repeated_rows(spark, folder, name):
    """Columns with names that operators use inside, and every row twice."""
    source, run = runs(spark, folder)[name]
    plain = table(spark, folder, source).limit(40)
    clash = plain.unionByName(plain)
    doubled = clash
    for column in ("hash", "node", "n", "item", "key", "_id", "_text", "component", "weight", "tokens", "_w", "_row", "topic", "h", "v", "shard", "parts", "status", "a.b", "block", "bucket", "gain", "score", "rank"):
        clash = clash.selectExpr("*", f"'x' AS `{column}`")
    made = run(clash)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, run(doubled).select(*made.columns).collect()))


def test_null_rows(spark, folder):
    """A row of nulls beside a plain one, for every operator."""
    for source, run in runs(spark, folder).values():
        plain = table(spark, folder, source).limit(3)
        nulls = spark.createDataFrame([tuple([None] * len(plain.columns))], plain.schema)
        made = run(plain.unionByName(nulls).unionByName(nulls))
        key = made.columns[0]
        ids = [r[key] for r in made.collect()]
        assert {r[key] for r in run(plain).collect()} <= set(ids) | {None} or source in ("embeddings", "pages"), (source, ids)


def test_empty_right_sides(spark, folder):
    docs = table(spark, folder, "documents").limit(30)
    clean = decontaminate.report(docs, table(spark, folder, "benchmark").limit(0)).collect()
    assert len(clean) == 30 and not any(r["contaminated"] for r in clean) and any(r["n_words"] > 0 for r in clean)
    scores = quality.classified(docs, table(spark, folder, "labels").limit(0)).collect()
    assert {round(r["score"], 6) for r in scores} == {0.5}
