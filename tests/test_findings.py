import json

import pytest
from pyspark.sql import functions as F

from lintlake.functions import severity as S, text as X
from lintlake.operators import dedup, gate, groups, stats, validate

FINDING = ("id string, rule string, severity string, category string, file string, line int, description string, explanation string, "
           "search_pattern string, scanner string, phase int, confidence string")


def finding(**over):
    row = dict(id="X-1", rule="R01", severity="HIGH", category="ssot-dry", file="a.ts", line=1, description="one two three four", explanation="e",
               search_pattern="p", scanner="s", phase=3, confidence="high")
    row.update(over)
    return tuple(row.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


@pytest.mark.parametrize("text,reason", [
    ("{bad", "invalid_json"), ("[1]", "not_a_dict"), ('{"rule":"","file":"a","line":0}', "missing_fields:rule,line,description"),
    ('{"rule":"R1","file":"a","line":"3","description":"d"}', "invalid_line_number:3"), ('{"rule":"R1","file":"a","line":-1,"description":"d"}', "invalid_line_number:-1"),
    ('{"rule":"R1","file":"gone","line":1,"description":"d"}', "phantom_file:gone"), ('{"rule":"R1","file":"a","line":1,"description":"d"}', None)])
def test_reject_reasons(spark, text, reason):
    raw = spark.createDataFrame([(text,)], "value string")
    files = spark.createDataFrame([("a",)], "path string")
    assert validate.checked(validate.parsed(raw), files).select("_reason").first()[0] == reason


def test_blank_lines_are_no_findings(spark):
    assert validate.parsed(spark.createDataFrame([("  ",), ("",)], "value string")).count() == 0


def test_ceiling_and_normalisation(spark):
    raw = spark.createDataFrame([(json.dumps(dict(rule="R05", file="a", line=2, description="d", severity="critical", confidence=c, category="x")),)
                                 for c in ("low", "medium", "high", "sure")], "value string")
    done = validate.normalised(validate.split(validate.checked(validate.parsed(raw)))[0])
    assert [(r.severity, r.severity_capped_from, r.category) for r in done.collect()] == [
        ("MEDIUM", "CRITICAL", "security"), ("HIGH", "CRITICAL", "security"), ("CRITICAL", None, "security"), ("MEDIUM", "CRITICAL", "security")]


def test_same_line_keeps_the_worst(spark):
    rows = dedup.same_line(frame(spark, finding(severity="LOW", scanner="b"), finding(severity="HIGH", scanner="a", explanation="short"),
                                 finding(severity="HIGH", scanner="c", explanation="much longer"), finding(rule="R02"))).collect()
    kept = {r.rule: r for r in rows}
    assert len(rows) == 2 and kept["R01"].explanation == "much longer" and kept["R01"].scanner == "a,b,c"


def test_near_merge_respects_names(spark):
    base = dict(description="verify is off in the call `get_client` here now")
    rows = frame(spark, finding(line=10, **base), finding(line=14, severity="CRITICAL", **base), finding(line=18, **base),
                 finding(line=22, description="verify is off in the call `post_data` here now"), finding(line=40, **base))
    merged = {r.line: (r.end_line, r.severity, r.merged) for r in dedup.merge_near(rows).collect()}
    assert merged == {10: (18, "CRITICAL", 3), 22: (22, "HIGH", 1), 40: (40, "HIGH", 1)}


def test_ids_count_per_prefix(spark):
    rows = frame(spark, finding(id="a", phase=3, file="b"), finding(id="b", phase=3, file="a"), finding(id="c", category="security", phase=1), finding(id="d", category="odd"))
    made = {r.id: r.new for r in dedup.assign_ids(rows, "new").collect()}
    assert made == {"b": "DRY-001", "a": "DRY-002", "c": "SEC-001", "d": "GEN-001"}


def test_cross_cutting_needs_three_files(spark):
    rows = frame(spark, *[finding(id=f, file=f) for f in "abc"], finding(id="d", search_pattern="q"), finding(id="e", search_pattern="q", file="z"))
    marked = {r.id: r.cross_cutting_group for r in groups.cross_cutting(rows).collect()}
    assert marked == {"a": "R01 across 3 files", "b": "R01 across 3 files", "c": "R01 across 3 files", "d": None, "e": None}


def test_family_pair_and_recollapse(spark):
    rows = frame(spark, finding(id="D1", severity="CRITICAL", file="b", search_pattern="Foo 12"), finding(id="D2", severity="CRITICAL", file="a", search_pattern="foo"),
                 finding(id="D3", severity="REVIEW", file="c", search_pattern="foo"), finding(id="D4", rule="R02", file="c", search_pattern="foo"))
    made = groups.families(rows)
    assert [tuple(r)[:4] for r in made.collect()] == [("FAM-001", "R01", "foo", "D2")]
    done = groups.collapse(rows, made)
    byid = {r.id: r for r in done.collect()}
    assert byid["D2"].is_root_cause and byid["D2"].severity == "CRITICAL"
    assert (byid["D1"].parent_finding_id, byid["D1"].severity, byid["D1"].original_severity) == ("D2", "HIGH", "CRITICAL")
    assert byid["D3"].family_id is None and byid["D4"].family_id is None
    again = groups.collapse(done, groups.families(done))
    assert {r.id: r.severity for r in again.collect()} == {r.id: r.severity for r in done.collect()}


def test_similar_wording_against_brute_force(spark):
    """Few words and tiny files force the combinations to grow up to the chain."""
    import random
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9)]
    texts = sorted({" ".join(sorted(rng.sample(vocabulary, rng.randint(3, 7)))) for _ in range(90)})
    rows = frame(spark, *[finding(id=str(i), file=f"f{i}", description=t, rule="R01" if i % 4 else "R02") for i, t in enumerate(texts)])
    by_key = {("R01" if i % 4 else "R02") + "|" + t: set(t.split()) for i, t in enumerate(texts)}
    parent = {k: k for k in by_key}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for threshold, bucket in ((0.6, 2), (0.6, 200), (0.75, 3)):
        parent = {k: k for k in by_key}
        for a in by_key:
            for b in by_key:
                if a < b and a[:3] == b[:3] and len(by_key[a] & by_key[b]) / len(by_key[a] | by_key[b]) > threshold:
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
        want = {k: root(k) for k in by_key}
        from lintlake.operators.graph import components
        got = {r.node: r.component for r in components(groups.similar_pairs(rows, threshold, bucket)).collect()}
        assert {k: got.get(k, k) for k in by_key} == want


def test_gate_boundaries(spark):
    def status(tier, rows, health=None):
        return {r.tier: r.status for r in gate.tiers(frame(spark, *rows), health).collect()}[tier]

    assert status("build", [finding(rule="R14", severity="HIGH")] * 5) == "WARN"
    assert status("build", [finding(rule="R14", severity="HIGH")] * 6) == "FAIL"
    assert status("security", [finding(rule="R05", severity="LOW")]) == "PASS"
    assert status("secrets", [finding(rule="R12", severity="LOW")]) == "WARN"
    assert status("architecture", [finding(rule="R01")]) == "PASS"
    for cov, dup, want_cov, want_dup in ((60.0, 5.0, "PASS", "PASS"), (48.0, 7.5, "WARN", "WARN"), (47.9, 7.6, "FAIL", "FAIL"), (None, None, "WARN", "WARN")):
        health = spark.createDataFrame([(cov, dup)], "coverage_line_pct double, duplication_pct double")
        assert status("coverage", [finding()], health) == want_cov
        assert status("duplication", [finding()], health) == want_dup


def test_readiness_and_verdict(spark):
    rows = frame(spark, finding(severity="CRITICAL"), finding(severity="REVIEW"), finding(severity="LOW"))
    scored = gate.readiness(rows, 2000)
    assert scored.first().readiness_score == 94.4
    tiers = spark.createDataFrame([("build", "WARN"), ("security", "PASS")], "tier string, status string")
    for score, want in ((90.0, "CONDITIONAL"), (70.0, "CONDITIONAL"), (63.0, "FAIL")):
        assert gate.overall(tiers, spark.createDataFrame([(score,)], "readiness_score double")).first().overall == want


def test_zero_fill_and_empty(spark):
    empty = frame(spark, finding()).limit(0)
    assert {r.severity: r.findings for r in stats.severity_counts(empty).collect()} == {s: 0 for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "REVIEW")}
    assert gate.readiness(empty, 0).first().readiness_score == 100.0
    assert gate.null_fix(empty.withColumn("target_code", F.lit(None).cast("string"))).first().triggered is False


def test_keys_and_adjustment(spark):
    one = spark.range(1)
    row = one.select(X.pattern_text(F.lit("Use `foo` In A1 42 x")).alias("a"), X.slug(F.lit("--Ab  C!d--")).alias("b"), X.parsed_count(F.lit("1,690")).alias("c"),
                     S.adjusted(F.lit("CRITICAL"), F.lit(0), F.lit(3)).alias("d"), S.adjusted(F.lit("LOW"), F.lit(0), F.lit(2)).alias("e"),
                     S.adjusted(F.lit("LOW"), F.lit(9), F.lit(0)).alias("f")).first()
    assert tuple(row) == ("use in a1 x", "ab-c-d", 1690, "HIGH", "LOW", "CRITICAL")
