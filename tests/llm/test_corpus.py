"""Operators over the statistics of a whole corpus: log-likelihood ratio, alignment, resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintlake.llm import align, likelihood, resample
from lintlake.llm.common import table

SCHEMA = "doc_id long, text string"
LONG = "wort für wort " * 30_000


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names or frame.columns) for r in frame.collect()), key=repr)


# --- op11 ---

def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    under = {p for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(under) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(under), failed


def ratios(docs, labels):
    """log_ratio of every text, by brute force."""
    marks = defaultdict(list)
    for key, quality, toxic in labels:
        marks[key].append(quality == 1 and not toxic)

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [zlib.crc32(g.encode()) % likelihood.BUCKETS for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    raw, good = Counter(), Counter()
    for key, text in docs:
        raw.update(grams(text))
        if key is not None and marks[key] and all(marks[key]):
            good.update(grams(text))
    s, t, size = sum(raw.values()), sum(good.values()), likelihood.BUCKETS
    return [sum(math.floor(1e6 * math.log((good[g] + 1) * float(s + size) / ((raw[g] + 1) * float(t + size)))) if t else 0 for g in grams(text)) for _, text in docs]


def test_log_ratio_against_brute_force(spark):
    rng = random.Random(11)
    fine, junk = ["river", "stone", "walks", "émile", "near"], ["BUY!!", "$$$", "<b>", "now"]
    docs = [(k, " ".join(rng.choice(fine if k % 3 else junk) + str(rng.randrange(40 if k % 3 else 9)) for _ in range(rng.randrange(30, 120)))) for k in range(60)]
    docs += [(100, "a b\n\n a b \n" * 40), (101, None), (101, ""), (None, "x y z " * 60), (7, docs[7][1]), (102, " \x1c  one"), (103, "一二 三\v四\f五 😀😀"), (104, LONG[:9000])]
    labels = [(k, int(k % 3 > 0), 0) for k in range(40)] + [(40, 1, 1), (41, 1, None), (42, None, 0), (1, 0, 0), (None, 1, 0)]
    given, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = sorted(((k, *base(t), r, not base(t)[5] and r >= likelihood.THRESHOLD * max(2 * base(t)[0] - 1, 0)) for (k, t), r in zip(docs, ratios(docs, labels))), key=repr)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    assert rows(likelihood.report(given, marks), *columns) == want
    assert {r[-1] for r in want} == {True, False} and any(not r[6] and not r[-1] for r in want)
    none = likelihood.report(given, marks.limit(0)).collect()
    assert len(none) == len(docs) and all(r["kept"] == (not r["base_failed"]) and r["log_ratio"] == 0 for r in none)


def test_log_ratio_keeps_good_and_drops_bad(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    made = [r for r in likelihood.report(table(spark, folder, "documents"), table(spark, folder, "labels")).collect() if not r["base_failed"]]
    good, bad = ([r["kept"] for r in made if labels.get(r["doc_id"]) == q] for q in (1, 0))
    assert all(good) and sum(bad) <= len(bad) / 4


# --- op12 ---

@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.FOLDER}/{align.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.B_FILE}")


def token_bytes(tokenizers, text):
    """[(id, bytes)] of A and of B by the libraries' own words."""
    a, b = tokenizers
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    one = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return one, two


def plain_alignment(tokenizers, docs):
    facts, counts = [], Counter()
    for key, text in docs:
        one, two = token_bytes(tokenizers, text) if text else ([], [])
        if not text or any(b"".join(x for _, x in s) != f" {text}".encode() for s in (one, two)):
            facts.append((key, 0, 0, "", 0, []))
            continue
        i = j = 0
        end_a, end_b, links, groups, left = len(one[0][1]), len(two[0][1]), [], [], (0, 0)
        while True:
            links.append((one[i][0], two[j][0]))
            go_a, go_b = end_a <= end_b, end_b <= end_a
            if go_a and go_b:
                groups.append(",".join(str(x) for x, _ in one[left[0]:i + 1]) + "|" + ",".join(str(x) for x, _ in two[left[1]:j + 1]))
                left = (i + 1, j + 1)
                if i + 1 == len(one):
                    break
            i, j = i + go_a, j + go_b
            end_a, end_b = end_a + (len(one[i][1]) if go_a else 0), end_b + (len(two[j][1]) if go_b else 0)
        counts.update(links)
        facts.append((key, len(one), len(two), ";".join(groups), len(groups), links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted([(k, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if links else "") for k, n_a, n_b, text, n_groups, links in facts], key=repr)


ODD = ["<|endoftext|>", "</s><s> [INST]", "a  b   c\n\n\t d\r\n", "naïve café ✓ 日本語テキスト 😀👩‍👩‍👧", "▁ already", "x\x00y", "don't I'll we've 'S", "   wide", " ", "\n", "    ", "ﬁ ① Å", "0123 456,789.0", "𝔘𝔫𝔦 ‮ rtl",
       "é combining", "ſſ İı", "A" * 3000, "😀" * 500, "﻿bom", "ab" * 5000, "!?" * 2000]


def test_alignment_against_brute_force(spark, folder, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()][:80]
    docs += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (5, None), (6, ""), docs[3], docs[3], (2000, LONG[:90_000])]
    want = plain_alignment(tokenizers, docs)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], f"{SCHEMA}, block string, code long")
    assert rows(align.report(given), *columns) == want
    assert any(w[1] == 0 and w[0] is not None and w[0] >= 1000 for w in want) and sum(w[1] > 0 for w in want) > 90


def test_blocks_and_pieces_change_nothing(spark, folder):
    docs = table(spark, folder, "documents").limit(40)
    columns = [c for c in align.found_in(docs).columns if c in align.FACTS]
    assert rows(align.found_in(docs, most=2000), *columns) == rows(align.found_in(docs), *columns)
    known = align.Encoders.load()
    texts = [r["text"] for r in docs.collect()] + [None, "", *ODD]
    plain = align.aligned(known, texts)
    for piece in (1, 2, 7, 100):
        made = align.aligned(known, texts, piece)
        assert made[0][0]["n_a"] > 0 and all(p["groups_sha256"] == m["groups_sha256"] and p["n_links"] == m["n_links"] and list(p["times"]) == list(m["times"]) for p, m in zip(plain[0], made[0]))
        assert all((p == m).all() for p, m in zip(plain[1:], made[1:]))


def test_diagonals_cut_equal_work():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 5000, n)) for n in (900, 60))
    end = max(a[-1], b[-1]) + 1
    a, b = np.append(a, end), np.append(b, end)
    i, j = align.diagonals(a, b, 64)
    assert (np.diff(i + j)[:-1] == 64).all() and i[-1] == len(a) and j[-1] == len(b)
    for x, y in zip(i[1:-1], j[1:-1]):
        assert (x == 0 or y == len(b) or a[x - 1] <= b[y]) and (y == 0 or x == len(a) or b[y - 1] < a[x])


# --- op13 ---

def plain_resampling(docs, target, percent=5, least=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    top, below = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    made = []
    for key, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[f] + 1.0) * top / ((s[f] + 1.0) * below))) for f in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        made.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n))
    order = sorted((r for r in made if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(order[:percent * len(order) // 100])]
    left = [(*r[:4], None) for r in order[len(drawn):]] + [(*r[:4], None) for r in made if r[4] < least]
    return sorted(drawn + left, key=repr)


def test_resampling_against_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    docs += [(None, "Some words " * 30), (9001, None), (9002, ""), (9003, "ÀÉ ß _x-1 \u0085 ab" * 9), (9004, LONG), *docs[:30], *docs[:30]]
    target = [r["text"] for r in table(spark, folder, "benchmark").collect()] + [None]
    given = spark.createDataFrame([(*d, 1, "x") for d in docs], f"{SCHEMA}, rank int, score string").repartition(5)
    for aim in (target, []):
        frame = spark.createDataFrame([(t,) for t in aim], "text string")
        assert rows(resample.report(given, frame)) == plain_resampling(docs, aim)


def test_few_documents_are_not_drawn(spark):
    given = spark.createDataFrame([(k, "word " * 25) for k in range(19)], SCHEMA)
    target = spark.createDataFrame([("word",)], "text string")
    assert [r["rank"] for r in resample.report(given, target).collect()] == [None] * 19
    assert resample.report(given.limit(0), target).collect() == []


@pytest.mark.parametrize("kind", ["mixed", "sorted", "equal", "hot"])
def test_cutoff_is_exact_and_discards_a_quarter(spark, kind):
    rng = random.Random(2)
    n = 4000
    fall = {"mixed": [rng.randrange(-10 ** 6, 10 ** 6) for _ in range(n)], "sorted": list(range(n)), "equal": [7] * n, "hot": [3 if k % 3 else k for k in range(n)]}[kind]
    keys = [(f, rng.randrange(n // 2)) for f in fall]
    frame = spark.createDataFrame(keys, "fall long, id long").repartition(9)
    for rank in (1, n // 20, n // 2, n):
        key, k, left = resample.cutoff(frame, lambda count, r=rank: r, last=20)
        assert (key, k) == (sorted(keys)[rank - 1], rank)
        assert all(4 * after <= 3 * before + 4 for before, after in zip(left, left[1:]))
    assert resample.cutoff(frame, lambda count: 0)[0] is None
