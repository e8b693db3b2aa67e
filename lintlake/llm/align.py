"""Cross-tokenizer alignment by merge-path partitioning.

Every text is encoded by a byte-level vocabulary A (space + text) and a piece vocabulary B (which adds the space
itself).  The tokens' ends, as byte offsets, are two sorted lists.  Their merge is cut by diagonals: a binary
search on each diagonal finds how many ends of A and of B lie before it, so the pieces between diagonals are
of equal work, ``PIECE`` steps, and independent of each other, whatever the lengths of the texts.  A piece emits
the overlaps that end in it: every different end is one pair of an A and a B token whose bytes overlap.  Where
both end, a group ends; an end of A that closes one piece and an equal end of B that opens the next are stitched,
and so are groups that run over several pieces.

Texts are worked off in blocks of consecutive rows with at most ``BLOCK`` bytes (one longer text makes a block of
its own).  A block tells its different id pairs and their numbers once, which turns hundreds of links into one
row, and no id pair can be hot: it occurs once per block at most.  The numbers are added up over the
corpus, the highest of each B id is found, and each block fetches the numbers of its own pairs.  What was
found per document lies in the shared folder meanwhile, as pairs of the block by position.

Defined cases: null and empty texts, and texts that either vocabulary changes, have no tokens and count zero
everywhere; strings of special tokens are plain text; ties of the highest number all count as best; rows that
occur several times are counted and returned several times; a null id stays null; an empty table gives no
rows; other columns are not looked at; long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lintlake.session import checkpoint_folder

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 1 << 20
PIECE = 1 << 16
SHIFT = 16  # bits of a B id in the code of a pair
# Fixed value: the published split of text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible ones for themselves, others from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Encoders:
    """Both vocabularies: encoders, and the bytes of every id."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self) -> None:
        self.a_sizes, self.b_sizes = (np.array(list(map(len, s)), np.int64) for s in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(len(str(most)) + 1, b"\0") for i in range(most)), np.uint8).reshape(most, -1)
        self.lengths = (self.digits != 0).sum(1)

    @staticmethod
    def load(folder: str = FOLDER) -> Encoders:
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{A_FILE}", encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        vocabulary = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{A_FILE}: ids do not follow the order of the merges")
        ordinary = set(merged)  # special tokens are letters of no merge
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if len(t) == 1 or i in ordinary}
        a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, number in ranks.items():
            a_bytes[number] = token
        b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        return Encoders(tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), b, a_bytes, pieces)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and B of every text, None where the bytes of either differ from space + text."""
        made = []
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = f" {text}"
            first = self.a.encode_ordinary(whole)
            raw = whole.encode()
            same = b"".join([self.a_bytes[i] for i in first]) == raw and b"".join([self.b_bytes[i] for i in ids]) == raw
            made.append((np.array(first, np.int64), np.array(ids, np.int64)) if same else None)
        return made


def diagonals(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B lie before each cut of the merge; equal ends come first from A."""
    n, m = len(a_ends), len(b_ends)
    at = np.append(np.arange(0, n + m, piece, dtype=np.int64), n + m)
    low, high = np.maximum(at - m, 0), np.minimum(at, n)
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        # The end of A in the middle comes before the cut if the end of B across from it is not smaller.
        ahead = np.zeros(len(at), bool)
        ahead[open_] = a_ends[middle[open_]] <= b_ends[at[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    return low, at - low


def merged(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (A, B) of all overlapping tokens, and positions (A, B) of the tokens that end together."""
    links_a, links_b, ties_a, ties_b = [], [], [], []
    cut_a, cut_b = diagonals(a_ends, b_ends, piece)
    for i0, i1, j0, j1 in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:], strict=True):
        a, b = a_ends[i0:i1], b_ends[j0:j1]
        # An end of A lies in the first token of B that ends there or later, which may open the next piece.
        across = j0 + np.searchsorted(b, a)
        own = np.arange(i0, i1)
        both = b_ends[across] == a
        back = np.searchsorted(a, b)
        alone = np.ones(len(b), bool)
        alone[across[both & (across < j1)] - j0] = False  # emitted by A
        if j1 > j0 and i0 > 0 and a_ends[i0 - 1] == b_ends[j0]:
            alone[0] = False  # emitted by the last end of the piece before
        links_a += [own, i0 + back[alone]]
        links_b += [across, np.arange(j0, j1)[alone]]
        ties_a.append(own[both])
        ties_b.append(across[both])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, ties_a, ties_b))


def _written(known: Encoders, a: np.ndarray, b: np.ndarray, ties_a: np.ndarray, ties_b: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, a1,a2|b1;a3|b2, as bytes, and the offset of the end of each text; ``closed`` counts the B tokens up to a text's end."""
    sizes_a, sizes_b = np.diff(ties_a, prepend=-1), np.diff(ties_b, prepend=-1)
    place_a = np.arange(len(a)) + np.repeat(ties_b - sizes_b + 1, sizes_a)  # after the B tokens of earlier groups
    place_b = np.arange(len(b)) + np.repeat(ties_a + 1, sizes_b)  # after the A tokens up to their group
    marks_a, marks_b = np.full(len(a), ord(","), np.uint8), np.full(len(b), ord(","), np.uint8)
    marks_a[ties_a], marks_b[ties_b] = ord("|"), ord(";")
    marks_b[closed - 1] = 0
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b], marks[place_a], marks[place_b] = a, b, marks_a, marks_b
    letters = np.concatenate([known.digits[ids], marks[:, None]], axis=1).ravel()
    ends = np.cumsum(known.lengths[ids] + (marks != 0))
    return letters[letters != 0], ends[place_b[closed - 1]]


def aligned(known: Encoders, texts: list[str | None], piece: int = PIECE) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """What is found in a block of texts: facts per text, and the block's different id pairs with their numbers.

    A text's pairs are positions among those of the block (``at``), each with its number (``times``)."""
    facts = [dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", at=[], times=[]) for _ in texts]
    have = [k for k, t in enumerate(texts) if t]
    found = [(k, ids) for k, ids in zip(have, known.encode([texts[k] for k in have]), strict=True) if ids is not None]
    if not found:
        return facts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([ids[side] for _, ids in found]) for side in range(2))
    n_a, n_b = (np.array([len(ids[side]) for _, ids in found]) for side in range(2))
    # The texts lie one after the other, so ends grow over the whole block and texts end where groups end.
    links_a, links_b, ties_a, ties_b = merged(np.cumsum(known.a_sizes[a]), np.cumsum(known.b_sizes[b]), piece)
    owner = np.repeat(np.arange(len(found)), n_a)
    n_groups = np.bincount(owner[ties_a], minlength=len(found))
    n_links = np.bincount(owner[links_a], minlength=len(found))
    codes, at, totals = np.unique(a[links_a] << SHIFT | b[links_b], return_inverse=True, return_counts=True)
    own, times = np.unique(owner[links_a] * len(codes) + at, return_counts=True)
    edges = np.searchsorted(own, np.arange(len(found) + 1) * len(codes))
    letters, ends = _written(known, a, b, ties_a, ties_b, np.cumsum(n_b))
    start, raw = 0, letters.tobytes()
    for k, (place, _) in enumerate(found):
        part = slice(edges[k], edges[k + 1])
        facts[place] = dict(n_a=int(n_a[k]), n_b=int(n_b[k]), n_groups=int(n_groups[k]), n_links=int(n_links[k]), groups_sha256=hashlib.sha256(raw[start:ends[k]]).hexdigest(),
                            at=(own[part] % len(codes)).astype(np.int32), times=times[part].astype(np.int32))
        start = ends[k]
    return facts, codes, totals


def _blocks(texts: list[str | None], most: int) -> Iterator[slice]:
    """Runs of consecutive texts with at most so many characters, one text at least."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > most and k > start:
            yield slice(start, k)
            start, size = k, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


FACTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}


def found_in(docs: DataFrame, folder: str = FOLDER, most: int = BLOCK) -> DataFrame:
    """Facts of every document with its block and pairs; the first row of a block holds the block's pairs."""
    schema = pa.schema([("block", pa.int64()), *FACTS.items(), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            known = known or Encoders.load(folder)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in _blocks(texts, most):
                facts, codes, totals = aligned(known, texts[block])
                rows = [{"block": number, "doc_id": i, **f, "codes": None, "totals": None} for i, f in zip(ids[block], facts, strict=True)]
                rows[0] |= {"codes": codes, "totals": totals}
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    types = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, codes array<long>, totals array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, types)


def counted(blocks: DataFrame) -> DataFrame:
    """code, count and whether the count is the highest of its B id, of every id pair of the corpus."""
    counts = blocks.select(F.explode(F.arrays_zip("codes", "totals")).alias("_p")).groupBy(F.col("_p.codes").alias("code")).agg(F.sum("_p.totals").alias("count"))
    second = F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1))
    highest = counts.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", second).join(highest, "b").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def report(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/aligned-{uuid.uuid4().hex}"
    found_in(docs, folder).write.parquet(path)
    found = spark.read.parquet(path)
    blocks = found.where(F.size("codes") > 0).select("block", "codes", "totals")
    wanted = blocks.select(F.col("block").alias("of"), F.posexplode("codes").alias("at", "code")).join(counted(blocks), "code").select("of", "at", "count", "best")
    out = pa.schema([*FACTS.items(), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def summed(rows: pa.Table, numbers: pa.Table) -> pa.Table:
        order = np.argsort(numbers["at"].to_numpy())
        count, best = numbers["count"].to_numpy()[order], numbers["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        made = rows.select(list(FACTS))
        at, times = (rows[c].combine_chunks() for c in ("at", "times"))
        ends = np.cumsum(np.append(0, at.value_lengths().to_numpy(zero_copy_only=False)))
        flat, n = at.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for name, values in (("n_best", best), ("count_sum", count)):
            sums = np.concatenate([[0], np.cumsum(values[flat] * n)])
            made = made.append_column(name, pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64()))
        return made.cast(out)

    types = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return found.drop("codes", "totals").groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(summed, types).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
