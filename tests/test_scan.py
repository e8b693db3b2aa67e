import pytest
from pyspark.sql import functions as F

from lintlake.catalog import rules as R
from lintlake.functions.guard import needed_text
from lintlake.functions.paths import glob_regex
from lintlake.operators import assertions, inventory, scan
from lintlake.sources import readers

FILES = {
    "src/app.ts": "import x from './y'\nconsole.log('a')\n// console.log('b')\nconst t: any = 1\nconst s = 'as any'\nel.innerHTML = ''\nel.innerHTML = x\n",
    "src/services/run.ts": "console.error('x')\nconst u = 'http://localhost:3000/x'\n",
    "src/latest/skip.ts": "console.log('skipped')\n",
    "scripts/ci/enforce-x.ts": "const RULE_PATTERNS = []\n// TODO later\neval('x')\n",
    "node_modules/a.ts": "eval('x')\n",
    "src/gen.ts": "// @generated\neval('x')\n",
    "src/a.test.ts": "test('adds', () => {\n  run()\n})\nit('checks', () => {\n  expect(1)\n})\n",
    "README.md": "eval(\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, content in FILES.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    return inventory.inventory(readers.source_tree(spark, str(root), "typescript", "r"))


def hits(frame):
    return {(r.file, r.line, r.rule) for r in frame.collect()}


def test_source_tree_prunes_and_filters(project):
    assert {r.path for r in project.collect()} == set(FILES) - {"node_modules/a.ts", "README.md"}


def test_inventory_tags(project):
    rows = {r.path: r for r in project.collect()}
    assert rows["src/gen.ts"].tag == "GENERATED" and rows["src/gen.ts"].skip_reason == "Generated source file"
    assert rows["src/a.test.ts"].tag == "TEST"
    assert rows["scripts/ci/enforce-x.ts"].is_meta_file and not rows["src/app.ts"].is_meta_file
    assert rows["src/app.ts"].loc == 7 and rows["src/app.ts"].nominal
    assert rows["src/services/run.ts"].layer == "services"


def test_rule_scan_exceptions(project):
    found = hits(scan.rule_scan(project))
    assert ("src/app.ts", 2, "R09") in found
    assert ("src/app.ts", 3, "R09") not in found            # a comment
    assert ("src/app.ts", 4, "R07") in found
    assert ("src/app.ts", 5, "R07") not in found            # only inside a literal
    assert ("src/app.ts", 6, "R05") not in found            # clearing is safe
    assert ("src/app.ts", 7, "R05") in found
    assert ("src/services/run.ts", 1, "R09") not in found   # off in this layer
    assert ("src/services/run.ts", 2, "R12") in found
    assert not any(f == "src/latest/skip.ts" for f, _, _ in found)
    assert ("scripts/ci/enforce-x.ts", 2, "R14") not in found and ("scripts/ci/enforce-x.ts", 3, "R05") in found
    assert not any(f in ("src/gen.ts", "src/a.test.ts") for f, _, _ in found)


def test_search_pattern_and_target(project):
    row = [r for r in scan.rule_scan(project).collect() if r.file == "src/app.ts" and r.line == 2][0]
    assert (row.search_pattern, row.target_code, row.scanner, row.layer) == ("console.log(", "", "grep-scanner", "misc")


def test_assertion_free(project):
    found = [(r.file, r.line, r.description) for r in assertions.assertion_free_tests(project).collect()]
    assert found == [("src/a.test.ts", 1, "Test 'adds' asserts nothing")]


def test_scan_does_not_shuffle(project):
    plan = scan.rule_scan(project)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("pattern,needed", [(r"console\.log\(", "console.log("), (r"a|bcd", ""), (r"(?i)abc", ""), (r"x+yz", "yz"), (r"\beval\(", "eval(")])
def test_needed_text(pattern, needed):
    assert needed_text(pattern) == needed


def test_needed_text_is_in_every_match():
    import re
    samples = ["console.log(1)", "x as any", "TODO", "eval(1)", "setTimeout(a, 30)", "catch (e) { throw e }", "http://localhost/"]
    for rule in R.TYPESCRIPT + R.PYTHON:
        for text in samples:
            if re.search(rule.pattern, text):
                assert needed_text(rule.pattern) in text


def test_own_literal_rules(spark):
    rules = R.house_literal_rules(["@acme/sdk"], [".routes.json"])
    files = spark.createDataFrame([("a.ts", "typescript", "misc", False, "import x from '@acme/sdk'\nopen(\".routes.json\")\nopen('@acme/sdkx')")],
                                  "path string, stack string, layer string, is_meta_file boolean, content string")
    assert hits(scan.rule_scan(files, {"typescript": rules})) == {("a.ts", 1, "R13"), ("a.ts", 2, "R13")}


def test_glob_crosses_folders():
    import re
    assert re.match(glob_regex("**/*.test.ts"), "a/b/c.test.ts") and not re.match(glob_regex("**/*.test.ts"), "c.test.ts")


def test_empty_and_missing_last_newline(spark):
    frame = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\n",)], "content string")
    from lintlake.functions.text import loc
    assert [r[0] for r in frame.select(loc(F.col("content"))).collect()] == [0, 1, 1, 2]


def test_long_files_are_scanned(spark):
    content = "console.log('a')\n" * 10_001
    files = inventory.inventory(spark.createDataFrame([("r", "src/long.ts", "typescript", content)], "repo string, path string, stack string, content string"))
    row = files.select("tag", "skip_reason").first()
    assert row.tag == "OVERSIZED" and row.skip_reason is None
    assert scan.rule_scan(files).where("rule = 'R09'").select("line").distinct().count() == 10_001


def test_code_of_a_finding_is_whole(spark):
    line = "console.log('" + "x" * 500 + "')"
    files = inventory.inventory(spark.createDataFrame([("r", "src/a.ts", "typescript", line)], "repo string, path string, stack string, content string"))
    row = scan.rule_scan(files).where("rule = 'R09'").first()
    assert row.current_code == line and row.snippet == line[:200]


def test_bodies_are_counted_to_their_end(spark):
    """A body that opens with more comment lines than the first look takes, and an empty one of that length."""
    comments, work = "    // note\n" * 60, "    a();\n" * 10
    files = spark.createDataFrame([
        ("full.ts", f"function f() {{\n{comments}{work}}}\n"), ("empty.ts", f"function f() {{\n{comments}}}\nfunction g() {{\n{work}}}\n"),
        ("full.py", "def f():\n" + "    # note\n" * 60 + "    a()\n" * 10), ("empty.py", "def f():\n" + "\n" * 60 + "    pass\nx = 1\ny = 2\nz = 3\nw = 4\nv = 5\n")], "path string, content string")
    assert sorted(r["path"] for r in scan.empty_functions(files).collect()) == ["empty.py", "empty.ts"]
