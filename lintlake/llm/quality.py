"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document becomes a sparse vector: the shares of its hashed words, statistics of its structure
(repetition, case, marks, lengths) and its stated size.  The score is

    sigmoid( w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) ),

the sum-of-squares form of all pairwise interactions, linear in the number of entries.  The model
is fitted with Adagrad on at most ``SAMPLE`` labelled rows, chosen by a hash of their id; it has a
fixed size, so it goes to the tasks with the code.  Language, source, id and labels are no inputs.

Defined cases: a null text counts as empty and is scored like any other; a null or missing n_chars
is replaced by the length of the text; documents with several labels take part with their mean;
without any training row, or with rows of one label only, the score is the share of that label
(0.5 without rows), no classifier is fitted and the filter keeps every document; repeated rows are
scored alike.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm.common import carrying, text_of

SAMPLE = 6000  # labelled rows that the model is fitted on at most
BUCKETS = 1 << 11
RANK = 6
EPOCHS = 30
ACCEPT = 0.7
_MARKS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"[^\w\s]{2,}")
N_STATS = 20


class Words(dict):
    """Numbers of words and what a document's vector needs of each, remembered for the words seen last.

    ``facts`` has, by number: bucket, marks, runs of marks, and whether it is alphanumeric, in upper case,
    capitalised, its digits, and whether it lacks letters and digits."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most
        self.facts = np.zeros((1024, 8), np.int64)

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        bucket = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        if word.isalpha() and word.islower():
            self.facts[number] = (bucket, 0, 0, 1, 0, 0, 0, 0)
        else:
            self.facts[number] = (bucket, len(_MARKS.findall(word)), len(_RUNS.findall(word)), word.isalnum(), word.isupper(),
                                  word[0].isupper(), sum(map(str.isdigit, word)), not any(map(str.isalnum, word)))
        self[word] = number
        return number

    def of(self, counts: dict[str, int]) -> np.ndarray:
        """The facts of a document's words; the memory is emptied when it would hold more than ``most``."""
        if len(self) + len(counts) > self.most:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        return self.facts[numbers]


def statistics(text: str, tokens: list[str], counts: np.ndarray, facts: np.ndarray, n_chars: float | None) -> list[float]:
    """Structure statistics of a text, each scaled to about -1 .. 1, and the stated size."""
    n, chars = len(tokens), len(text)
    if not n:
        return [1.0, *[0.0] * (N_STATS - 1)]
    # Marks, runs of marks and digits lie within words, so their numbers add up from those of the words.
    _, marks, runs, bare, upper, title, digits, alone = (counts @ facts).tolist()
    same = sum(map(operator.eq, tokens, tokens[1:]))
    most = int(counts.max())
    lines = text.split("\n")
    size = n_chars if n_chars is not None and n_chars >= 0 else chars
    # Types grow more slowly than tokens: compare with a Heaps-like expectation.
    expected = min(n, 3 * n ** 0.75)
    return [
        0.0, math.log1p(n) / 10, math.log1p(chars) / 13, len(counts) / n, len(counts) / expected, same / n, math.sqrt(same / n), most / n,
        math.sqrt(marks / chars), min(1.0, 3 * runs / n), min(1.0, marks / n), bare / n, upper / n, title / n, math.sqrt(digits / chars),
        alone / n, math.log1p(chars / n) / 3, math.log1p(len(lines)) / 6, len(set(lines)) / len(lines), math.log1p(size) / 13]


def features(text: str | None, n_chars: float | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's vector."""
    text = text or ""
    tokens = text.split()
    words = Counter(tokens)
    counts = np.fromiter(words.values(), np.int64, len(words))
    facts = known.of(words)
    stats = statistics(text, tokens, counts, facts, n_chars)
    shares = np.sqrt(counts / len(tokens)) if len(counts) else np.zeros(0)
    return np.concatenate([facts[:, 0], np.arange(BUCKETS, BUCKETS + N_STATS)]), np.concatenate([shares, stats])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    fitted: bool = True  # False where the labels tell nothing apart

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of the good label, for sparse rows, in one go."""
        if not rows:
            return np.zeros(0)
        at = np.concatenate([r[0] for r in rows])
        values = np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
        first = np.add.reduceat(self.linear[at] * values, starts)
        parts = self.factors[at] * values[:, None]
        sums = np.add.reduceat(parts, starts)
        squares = np.add.reduceat(parts * parts, starts)
        z = self.bias + first + 0.5 * (sums * sums - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adagrad on the logistic loss with a little ridge; steps over batches of dense rows."""
    size = BUCKETS + N_STATS
    rng = np.random.default_rng(seed)
    if not len(rows) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(rows) else 0.5, 1e-6, 1 - 1e-6))
        return Model(math.log(share / (1 - share)), np.zeros(size), np.zeros((size, RANK)), False)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    b = math.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    # A rare label counts as much as a third of the common one.
    good = labels >= 0.5
    weight = np.where(good, 1.0, max(1.0, good.sum() / max(1, 3 * (~good).sum())))
    batch = 64
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            picked = order[start:start + batch]
            x = np.zeros((len(picked), size))
            for k, r in enumerate(picked):
                np.add.at(x[k], rows[r][0], rows[r][1])
            s = x @ v
            z = b + x @ w + 0.5 * (s * s - (x * x) @ (v * v)).sum(1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[picked]) * weight[picked] / len(picked)
            step_b, step_w = d.sum(), x.T @ d + 1e-5 * w
            step_v = x.T @ (d[:, None] * s) - v * ((x * x).T @ d)[:, None] + 1e-5 * v
            gb += step_b ** 2
            gw += step_w ** 2
            gv += step_v ** 2
            rate = 0.3 if epoch < epochs * 2 // 3 else 0.1
            b -= rate * step_b / math.sqrt(gb)
            w -= rate * step_w / np.sqrt(gw)
            v -= 0.3 * rate * step_v / np.sqrt(gv)
    return Model(float(b), w, v)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a null id is not held out and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _size(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on a bounded sample of labelled rows that are not held out."""
    given = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most ``sample`` ids: the texts stay where they are.
    picked = docs.select("doc_id", text_of().alias("_text"), _size(docs).alias("_size")).join(F.broadcast(given), "doc_id")
    picked = picked.dropDuplicates(["doc_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for frame in frames:
            made = [features(t, None if s != s else s, known) for t, s in zip(frame["_text"], frame["_size"].astype(float), strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["_label"], "at": [m[0] for m in made], "value": [m[1] for m in made]})

    found = picked.mapInPandas(run, "doc_id long, label double, at array<long>, value array<double>").toPandas().sort_values("doc_id")
    return fit([(np.asarray(a), np.asarray(v)) for a, v in zip(found["at"], found["value"], strict=True)], (found["label"].to_numpy() >= 0.5).astype(float))


def scorer(model: Model):
    """A column function (text, n_chars) -> score."""
    @F.pandas_udf("double")
    def score(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Words()
        for texts, sizes in frames:
            made = [features(t, None if s is None or s != s else float(s), known) for t, s in zip(texts, sizes, strict=True)]
            # Small groups keep the gathered factors small whatever the batch.
            yield pd.Series(np.concatenate([np.zeros(0), *[model.scores(made[k:k + 256]) for k in range(0, len(made), 256)]]))

    return score


def score(docs: DataFrame, model: Model) -> Column:
    return scorer(model)(text_of(), _size(docs))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels)
    return (docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0)))


@carrying
def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns; all where none could be fitted."""
    model = train(docs, labels)
    return docs.where(score(docs, model) >= ACCEPT) if model.fitted else docs
