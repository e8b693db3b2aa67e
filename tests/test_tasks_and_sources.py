import os
import random

from pyspark.sql import functions as F

from lintlake.operators import duplicates, tasks, verify
from lintlake.operators.marks import only_marked
from lintlake.sources import readers, reports, sinks
from lintlake.streaming import intake


def test_relocation(spark):
    text = "\n".join(["zero"] + [f"line {i}" for i in range(2, 40)] + ["the needle here"] + ["x"] * 100 + ["the needle here", "tail text"])
    files = spark.createDataFrame([("a.ts", text), ("b.ts", "needle up\nmid\nmiddle\nneedle up")], "path string, content string")
    rows = spark.createDataFrame([(1, "a.ts", 40, "  the needle\n more"), (2, "a.ts", 45, "needle here"), (3, "a.ts", 130, "tail text"), (4, "a.ts", 5, "not there at all"), (5, "gone.ts", 5, "whatever it is"),
                                  (6, "gone.ts", 7, "ab"), (7, "a.ts", 90, "zero"), (8, "a.ts", 90, "line 33"), (9, "b.ts", 2, "needle up"), (10, "b.ts", 3, "needle up")],
                                 "task_id int, file string, line int, code string")
    got = {r.task_id: (r.match, r.found_line, r.outcome) for r in tasks.relocate(rows, files).collect()}
    assert got == {1: ("exact", 40, "valid"), 2: ("nearby", 40, "line_updated"), 3: ("nearby", 142, "line_updated"), 4: ("not_found", None, "already_resolved"),
                   5: ("file_missing", None, "already_resolved"), 6: ("exact", 7, "valid"), 7: ("exact", 90, "valid"), 8: ("file_wide", 33, "needs_rescan"),
                   9: ("nearby", 1, "line_updated"), 10: ("nearby", 4, "line_updated")}


def test_relocation_against_brute_force(spark, monkeypatch):
    """Many tasks of one file, few together, every line of short files; only files that tasks name are joined."""
    monkeypatch.setattr(tasks, "TOGETHER", 7)
    rng = random.Random(8)
    texts = {f"f{k}": "\n".join(rng.choice(["alpha beta", "gamma alpha beta", "delta one", "epsilon", "", "x"]) for _ in range(rng.randrange(0, 90))) + rng.choice(["", "\n"]) for k in range(12)}
    texts |= {"null": None, "crlf": "first line\r\nsecond line\r\n"}
    cited = [(n, rng.choice(["f0", "f0", "f0", *texts, "gone", None]), rng.randrange(0, 95), rng.choice(["alpha beta", " gamma\nx", "delta o", "epsilon", "nothing", "x", None, "second line"])) for n in range(400)]

    def plain(file, line, code):
        needle = (code or "").strip(" \t\r\n").split("\n")[0].strip(" \t\r\n")
        if len(needle) < 5:
            return "exact", line
        if file not in texts:
            return "file_missing", None
        lines = (texts[file] or "").split("\n")
        hits = [k + 1 for k, text in enumerate(lines) if needle in text]
        near = sorted((abs(h - line), h < line, h) for h in hits if abs(h - line) <= 20)
        return ("exact" if near[0][0] == 0 else "nearby", near[0][2]) if near else ("file_wide", hits[0]) if hits else ("not_found", None)

    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    made = tasks.relocate(spark.createDataFrame(cited, "task_id int, file string, line int, code string"), files)
    assert {r.task_id: (r.match, r.found_line) for r in made.collect()} == {n: plain(*rest) for n, *rest in cited}
    checked = tasks.snippet_check(spark.createDataFrame([(n, f, k, c or "") for n, f, k, c in cited], "id int, file string, line int, snippet string"), files)

    def real(file):
        text = texts.get(file) or ""
        return (text[:-1] if text.endswith("\n") else text).split("\n") if text else []

    want = {n: any((c or "").split("\n")[0] in text for text in real(f)[max(k - 6, 0):max(k + 5, 0)]) for n, f, k, c in cited}
    assert {r.id: r.valid for r in checked.collect()} == want


def test_only_named_files_travel(spark):
    files = spark.createDataFrame([(f"f{k}", "text") for k in range(500)], "path string, content string")
    kept = {r.path for r in only_marked(files, "path", spark.createDataFrame([("f7",), ("f8",), ("gone",)], "file string"), "file").collect()}
    assert {"f7", "f8"} <= kept and len(kept) < 10


def test_progress_states(spark):
    rows = spark.createDataFrame([(0, "pending", None), (1, "completed", "applied"), (2, "completed", "failed"), (2, "pending", None), (3, "skipped", None)], "phase int, status string, resolution string")
    got = {r.phase: (r.status, r.resolved, r.skipped, r.failed) for r in tasks.progress(rows).collect()}
    assert got[0] == ("NOT STARTED", 0, 0, 0) and got[1] == ("COMPLETE", 1, 0, 0) and got[2] == ("IN PROGRESS", 0, 0, 1) and got[3] == ("COMPLETE", 0, 1, 0) and got[4] == ("EMPTY", 0, 0, 0)


def test_sample_sizes(spark):
    frame = spark.range(1)
    sizes = [frame.select(verify.evidence_sample_size(F.lit(n)), verify.snippet_sample_size(F.lit(n))).first() for n in (5, 50, 500, 5000)]
    assert [tuple(r) for r in sizes] == [(5, 5), (10, 10), (20, 50), (20, 50)]


def test_verdict(spark):
    claims = spark.createDataFrame([(1, "VERIFIED"), (2, "STUB")], "req_id int, status string")
    good = spark.createDataFrame([(1, "IMPLEMENTED"), (2, "IMPLEMENTED")], "req_id int, rating string")
    assert verify.verdict(claims, good).first().verdict == "CLEAR"
    assert verify.verdict(claims, good, spark.range(2)).first().blocked_at == "gate_4"
    assert verify.verdict(claims, good, hard_failures=1).first().blocked_at == "gate_5_deterministic"
    partial = spark.createDataFrame([(1, "PARTIAL")], "req_id int, rating string")
    assert verify.verdict(claims, partial).first().blocked_at == "gate_3"
    assert verify.verdict(claims, partial, blocking=["SHELL", "MISSING"]).first().verdict == "CLEAR"


def test_duplicate_stretches(spark):
    same = "\n".join(f"row {i}" for i in range(8))
    files = spark.createDataFrame([("a", "top\n" + same + "\nend"), ("b", same), ("c", "a\nb\nc\nd\ne")], "path string, content string")
    assert sorted(tuple(r) for r in duplicates.blocks(files).collect()) == [("a", 2, 9, 8), ("b", 1, 8, 8)]
    assert duplicates.duplication(files).first().duplication_pct == round(16 * 100 / 23, 2)


def test_readers_and_sinks(spark, tmp_path):
    root = str(tmp_path / "out")
    os.makedirs(root)
    (tmp_path / "out" / "one.jsonl").write_text('{"rule":"R1","file":"a","line":3,"phase":"x"}\n\nbroken\n{"rule":"R2","file":"b","line":"4"}\n')
    rows = {r.rule: (r.line, r.phase, r.source) for r in readers.findings(spark, root).collect()}
    assert rows == {"R1": (3, None, "one.jsonl"), "R2": (4, None, "one.jsonl")}
    assert [(r.line_no, r.value) for r in readers.numbered_json_lines(spark, root).orderBy("line_no").collect()][2] == (3, "broken")
    assert readers.json_lines(spark, root).count() == 3
    (tmp_path / "good.json").write_text('{\n "total": 3,\n "files": ["a"]\n}')
    (tmp_path / "bad.json").write_text('{\n "total": 3,')
    assert [r.total for r in readers.json_object(spark, str(tmp_path / "*.json"), "total int, files array<string>").collect()] == [3]
    (tmp_path / "log.jsonl").write_text('{"repo":"r","timestamp":"2024-01-01T00:00:00Z","score":1.5}\noops\n{"repo":"r"}\n')
    assert [r.score for r in readers.history(spark, str(tmp_path / "log.jsonl")).collect()] == [1.5]
    made = sinks.published(spark, root).first()
    assert made.line_count == 4 and made.size_bytes == 96 or made.size_bytes > 0


def test_reports_with_odd_rows(spark):
    def texts(*values):
        return spark.createDataFrame([(v,) for v in values], "content string")

    assert reports.eslint(texts("", "not json", "[]", '[{"filePath":"/w/a.ts","messages":[]}]')).count() == 0
    assert reports.madge(texts('[["a"],["a","b"]]')).first().description == "Imports run in a circle: a -> b"
    assert reports.checkstyle(texts('<checkstyle><file name="a"><error line="1" severity="error" message="m" source=""/><error line="2" message="n"/></file></checkstyle>')).count() == 2
    assert reports.pip_audit(texts('{"dependencies":[{"name":"x","version":"1","vulns":[]}]}')).count() == 0
    one = reports.istanbul(texts('{"a.ts":{"fnMap":{},"f":{"3":0}}}')).first()
    assert (one.description, one.line, one.phase, one.category) == ("Function 'anonymous_3' has zero test coverage", 1, 9, "build")


def test_intake_is_reentrant(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    paths = [str(tmp_path / n) for n in ("valid", "rejected", "done")]
    (home / "a.jsonl").write_text('{"rule":"R1","file":"a","line":3,"description":"d"}\nbroken\n')
    intake.intake(spark, str(home), *paths)
    (home / "b.jsonl").write_text('{"rule":"R2","file":"b","line":4,"description":"d"}\n')
    intake.intake(spark, str(home), *paths)
    intake.intake(spark, str(home), *paths)
    assert sorted(r.rule for r in spark.read.parquet(paths[0]).collect()) == ["R1", "R2"]
    assert [r._reason for r in spark.read.parquet(paths[1]).collect()] == ["invalid_json"]
