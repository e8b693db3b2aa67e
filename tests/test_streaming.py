"""Running totals that do not depend on how rows arrive."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.streaming import intake

START = datetime.datetime(2024, 3, 1)
SCHEMA = "repo string, ts timestamp, tokens long"


def dealt(rows, folder, files, rng):
    """The rows as JSON files in one dealing."""
    folder.mkdir()
    shuffled = rng.sample(rows, len(rows))
    for k in range(files):
        (folder / f"part{k:02d}.json").write_text("".join(json.dumps({"repo": r, "ts": t.isoformat() if t else None, "tokens": n}) + "\n" for r, t, n in shuffled[k::files]))
    return str(folder)


@pytest.mark.parametrize("seed", range(3))
def test_any_dealing_gives_the_same_totals(spark, tmp_path, seed):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(3)}", START + datetime.timedelta(hours=rng.randrange(240)), rng.randrange(1, 90)) for _ in range(150)]
    want = {}
    for repo, ts, n in rows:
        key = (ts.replace(hour=0), repo)
        used, runs = want.get(key, (0, 0))
        want[key] = (used + n, runs + 1)
    rng = random.Random(seed)
    source = dealt(rows, tmp_path / "in", 1 + 4 * seed, rng)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    out = str(tmp_path / "out")
    intake.usage_windows(stream, out, str(tmp_path / "done"))
    made = intake.latest_windows(spark, out).collect()
    assert {(r.window_start, r.repo): (r.used, r.runs) for r in made} == want
    assert sum(r.late_runs for r in made) == 0 if seed == 0 else sum(r.late_runs for r in made) > 0
    # A later run goes on where the last one stopped, also from the compacted table.
    intake.compact_windows(spark, out, str(tmp_path / "short"))
    assert spark.read.parquet(str(tmp_path / "short")).count() == len(want)
    assert {(r.window_start, r.repo): (r.used, r.runs) for r in intake.latest_windows(spark, str(tmp_path / "short")).collect()} == want


def test_late_rows_count_and_are_told_apart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, done = str(tmp_path / "out"), str(tmp_path / "done")

    def run(name, rows):
        (folder / name).write_text("".join(json.dumps({"repo": r, "ts": t, "tokens": n}) + "\n" for r, t, n in rows))
        intake.usage_windows(spark.readStream.schema(SCHEMA).json(str(folder)), out, done)
        return {(str(r.window_start.date()), r.repo): (r.used, r.runs, r.late_runs) for r in intake.latest_windows(spark, out).collect()}

    assert run("a.json", [("x", "2024-03-01T10:00:00", 5), ("x", "2024-03-03T10:00:00", 7)]) == {("2024-03-01", "x"): (5, 1, 0), ("2024-03-03", "x"): (7, 1, 0)}
    assert run("b.json", [("x", "2024-03-01T11:00:00", 1), ("x", "2024-03-03T00:30:00", 2), ("y", "2024-03-02T23:59:00", 4)]) == {
        ("2024-03-01", "x"): (6, 2, 1), ("2024-03-03", "x"): (9, 2, 0), ("2024-03-02", "y"): (4, 1, 1)}
    batches = spark.read.parquet(out).select("batch").distinct().count()
    assert batches == 2 and spark.read.parquet(out).agg(F.max("batch")).first()[0] == 1
