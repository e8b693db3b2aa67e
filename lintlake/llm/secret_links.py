"""Secret scan with multipart credential linking.

Every whole text is searched for the parts of credentials: strong secrets (an assignment to a
secret name, an access key, a long hexadecimal run) and weak parts that mean nothing alone
(identifiers, opaque tokens, endpoints).  The parts of a text lie on a line of code points that
is cut into scopes (blocks between empty lines).  An interval join within the scope links a part
to the nearest complementary parts within ``REACH`` code points: as parts are ordered, the nearest
on each side comes from one sorted pass of a window, so no pairs are made.  Strong secrets are
always reported; a weak part is reported only where complementary parts are within reach:

* an opaque token needs an identifier (or access key);
* an identifier and an endpoint need a secret, strong or an opaque token that has an identifier.

Defined cases: a null text counts as empty; a text without parts gives zero counts and empty lists;
repeated rows give repeated results, whatever their ids; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.llm.common import carrying, text_of

REACH = 400  # code points between two parts of one credential at most
#: The kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
BASE = KINDS[:3]

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_TRACE = re.compile(r"[0-9a-f]{3}")  # what a run of 24 leaves in every 7th code point
_IDENT = re.compile(r"""(?:client_?id|user_?name|username|user_?id|login|account|access_?key(?:_?id)?|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.I | re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?:host|hostname|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", re.I | re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")


def parts(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, scope) of all parts of a text.

    The first tests only skip texts in which a pattern cannot match."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower() if ":" in text or "=" in text else ""
    if lower and any(name in lower for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    if _HEX_TRACE.search(text[::7]):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    weak: list[tuple[str, int, int]] = []
    if lower and any(name in lower for name in ("client", "user", "login", "account", "access")):
        weak += [("ident", m.start(), m.end()) for m in _IDENT.finditer(text)]
    if found or weak:  # an endpoint or a token alone is never reported
        taken = [(s, e) for _, s, e in found]
        weak += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
        weak += [("opaque", m.start(), m.end()) for m in _OPAQUE.finditer(text)]
        weak = [w for w in weak if w[0] != "opaque" or not any(s < w[2] and w[1] < e for s, e in taken)] if len(taken) < 50 else _apart(weak, taken)
    if not weak:
        return [(*f, 0) for f in found]
    breaks = [m.start() for m in _BLANK.finditer(text)]
    return [(k, s, e, _before(breaks, s)) for k, s, e in found + weak]


def _before(breaks: list[int], at: int) -> int:
    from bisect import bisect_left

    return bisect_left(breaks, at)


def _apart(weak: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts without opaque tokens that overlap a strong one, for long lists."""
    from bisect import bisect_left

    taken = sorted(taken)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    return [w for w in weak if w[0] != "opaque" or not ((k := bisect_left(starts, w[2])) and ends[k - 1] > w[1])]


_PARTS = "array<struct<kind:int,start:long,end:long,scope:long>>"


def found_parts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``_doc``, a struct of the columns ``keep``, and ``_parts`` of every row; ``text`` is read whole."""
    names = [f"_k{i}" for i in range(len(keep))]
    kept = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], text_of().alias("_text"))
    schema = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[{"kind": KINDS.index(k), "start": s, "end": e, "scope": b} for k, s, e, b in parts(t)] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(made, schema)], names=[*names, "_parts"])

    types = dict(kept.dtypes)
    out = ", ".join([*[f"{n} {types[n]}" for n in names], f"_parts {_PARTS}"])
    return kept.mapInArrow(run, out).select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]).alias("_doc"), "_parts")


def linked(rows: DataFrame, row: str = "_row") -> DataFrame:
    """From rows (``row``, kind, start, end, scope): the same with ``reported`` and ``credential``, the
    start of the secret that a part belongs to.  One window per row of text: the nearest part of each
    sort before and after, kept if it is in the scope and within reach."""
    before = Window.partitionBy(row).orderBy("start", "kind", "end")
    after = Window.partitionBy(row).orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    kind = {k: i for i, k in enumerate(KINDS)}
    here = F.struct(F.col("scope"), F.col("start").alias("at"), F.col("end").alias("to"))
    strong = F.col("kind") <= kind["hex"]
    names = (F.col("kind") == kind["ident"]) | (F.col("kind") == kind["access"])

    def near(test: Column) -> tuple[Column, Column]:
        seen = F.when(test, here)
        return (F.last(seen, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)),
                F.last(seen, ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1)))

    def close(part: str) -> Column:
        gap = F.greatest(F.col("start") - F.col(f"{part}.to"), F.col(f"{part}.at") - F.col("end"))
        return F.coalesce((F.col(f"{part}.scope") == F.col("scope")) & (gap <= REACH), F.lit(False))

    name_before, name_after = near(names)
    named = rows.withColumn("_nb", name_before).withColumn("_na", name_after).withColumn("_named", close("_nb") | close("_na"))
    holds = strong | ((F.col("kind") == kind["opaque"]) & F.col("_named"))
    secret_before, secret_after = near(holds)
    both = named.withColumn("_sb", secret_before).withColumn("_sa", secret_after)
    # An opaque token that holds nothing has no identifier, so a secret nearby does not make it a part.
    whose = (F.when(holds, F.col("start")).when(F.col("kind") == kind["opaque"], F.lit(None))
             .when(close("_sb"), F.col("_sb.at")).when(close("_sa"), F.col("_sa.at")))
    return (both.withColumn("credential", whose)
            .withColumn("reported", F.col("credential").isNotNull())
            .drop("_nb", "_na", "_named", "_sb", "_sa"))


def _spans(parts_column: str) -> Column:
    """kind:start:end of a sorted array of parts, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts_column, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``_spans``, the reported parts by start and kind, of every row.

    One pass over the texts: the first part of a row carries its columns, and a row without parts
    travels as one row of nulls, which is nobody's neighbour."""
    found = found_parts(docs, keep).withColumn("_row", F.monotonically_increasing_id())
    flat = found.select("_row", "_doc", F.posexplode_outer("_parts").alias("_pos", "_p")).select(
        "_row", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_doc")).alias("_doc"), "_p.*")
    part = F.struct("start", "kind", "end", "credential")
    return (linked(flat).groupBy("_row")
            .agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.array_sort(F.collect_list(F.when(F.col("reported"), part))).alias("_spans"))
            .select("_doc.*", "_spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the three base kinds, base_sha256, spans, n_linked and n_credentials of every row."""
    return _digest(scanned(docs, ["doc_id"]))


def _digest(rows: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("_spans", lambda p: p["kind"] == KINDS.index(kind))).cast("long")
    base = rows.withColumn("_base", F.filter("_spans", lambda p: p["kind"] < len(BASE)))
    return base.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_spans("_base").cast("binary"), 256).alias("base_sha256"), _spans("_spans").alias("spans"),
        F.size(F.filter("_spans", lambda p: p["kind"] >= len(BASE))).cast("long").alias("n_linked"),
        F.size(F.array_distinct(F.transform("_spans", lambda p: p["credential"]))).cast("long").alias("n_credentials"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans by that of the first."""
    made, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            made += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*made, text[at:]])


@carrying
def redact(docs: DataFrame) -> DataFrame:
    """The documents with every reported part of a credential replaced by its kind, and ``n_chars`` set anew
    where a text changed.  Texts that hold none of the words and characters that a reported part needs stay
    on the JVM and out of the shuffle."""
    columns = docs.columns
    may = text_of().rlike(r"(?i)password|passwd|secret|token|api_?key|client|user|login|account|access|AKIA|[0-9a-f]{24}")
    hits = scanned(docs.where(may), columns)
    at = columns.index("text")
    size = columns.index("n_chars") if "n_chars" in columns else None
    names = [f"_k{i}" for i in range(len(columns))]
    wide = hits.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.transform("_spans", lambda p: F.struct(p["start"], p["kind"], p["end"])).alias("_spans"))
    kinds = dict(wide.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names[at]).to_pylist()
            new = [t if not s else redacted(t, [tuple(p.values()) for p in s]) for t, s in zip(old, batch.column("_spans").to_pylist(), strict=True)]
            arrays = [batch.column(n) for n in names]
            arrays[at] = pa.array(new, pa.string())
            if size is not None:
                counts = [n if a == b else len(b) for n, a, b in zip(arrays[size].to_pylist(), old, new, strict=True)]
                arrays[size] = pa.array(counts, arrays[size].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    made = wide.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    return docs.where(~may).unionByName(made.withColumnsRenamed(dict(zip(names, columns, strict=True))))
