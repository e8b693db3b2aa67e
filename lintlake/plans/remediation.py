"""Third stage: where the tasks stand and what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintlake.operators import tasks as T, verify


def run(tasks: DataFrame, files: DataFrame, decided: DataFrame, bulk: DataFrame) -> dict[str, DataFrame]:
    """tasks(task_id, phase, file, line, code, rule, status, resolution, confidence, completed_at)."""
    pending = tasks.where("status = 'pending'")
    return {"progress": T.progress(tasks), "summary": T.remediation(tasks), "routes": T.route(tasks, decided, bulk), "next": T.next_task(tasks),
            "unordered": T.order_violations(tasks), "relocated": T.relocate(pending, files)}


def verdict(claims: DataFrame, ratings: DataFrame, failed_checks: DataFrame) -> dict[str, DataFrame]:
    """Builder claims against independent ratings and run-time checks."""
    return {"requirements": verify.reconcile(claims, ratings), "unrated": verify.unrated(claims, ratings),
            "verdict": verify.verdict(claims, ratings, failed_checks)}
