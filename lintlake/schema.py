"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FIX_STEP = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("old_code", T.StringType()),
    T.StructField("new_code", T.StringType()),
])

# As read: numbers stay strings so that a bad one can be named in the reject reason.
RAW_FINDING = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "id", "rule", "severity", "category", "file", "line", "end_line", "snippet",
        "current_code", "description", "explanation", "search_pattern", "target_code",
        "target_import", "phase", "effort", "layer", "scanner", "confidence",
        "confidence_reason", "tool_rule_id")]
    + [T.StructField("fix_plan", T.ArrayType(FIX_STEP)),
       T.StructField("cwe", T.ArrayType(T.StringType()))])

# After validation.
FINDING_COLUMNS = ["rule", "severity", "category", "file", "line", "end_line", "snippet",
                   "current_code", "description", "explanation", "search_pattern", "phase",
                   "effort", "scanner", "confidence", "confidence_reason", "tool_rule_id", "cwe"]

HISTORY = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("findings", T.LongType()),
    T.StructField("critical", T.LongType()),
    T.StructField("coverage", T.DoubleType()),
])
