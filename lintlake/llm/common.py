"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: The columns of documents that operators read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(function):
    """For a function of documents that returns documents with the same columns: columns that no operator reads
    pass it under names of their own, so that none clashes with a helper's or has to be quoted."""
    @functools.wraps(function)
    def run(docs: DataFrame, *more, **options) -> DataFrame:
        names = docs.columns
        return function(docs.toDF(*[n if n in READ else f"carried_{k}" for k, n in enumerate(names)]), *more, **options).toDF(*names)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark from wherever the folder lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Hashes(dict):
    """64-bit hashes of strings that every worker agrees on, remembered for the words seen last.

    The memory is emptied when it holds ``most`` words, so it stays bounded."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return made


#: CRC-32 of single bytes, made by the rule of its polynomial.
CRC_TABLE: list[int] = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ (0xEDB88320 if _byte & 1 else 0)
    CRC_TABLE.append(_byte)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    code = f"hex(encode({text}))"
    table = f"[{', '.join(map(str, CRC_TABLE))}]::BIGINT[]"
    steps = f"list_transform(range(0, len({code}) // 2), lambda i: CAST('0x' || {code}[2 * i + 1:2 * i + 2] AS BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce({steps}, lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"
