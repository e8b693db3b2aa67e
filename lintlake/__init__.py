"""lintlake: code-audit findings analytics as Spark jobs."""
