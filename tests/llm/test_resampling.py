import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from tests.conftest import SMALL
from usagelens.llm import resampling
from usagelens.llm.resampling import BUCKETS


def slow_features(text, ngrams=1):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    grams = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return Counter(zlib.crc32(g.encode()) % BUCKETS for g in grams), len(words), len(grams)


def slow(rows, target, percent=10, ngrams=1):
    found = [(i, *slow_features(t, ngrams)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, c, *_ in found:
        s.update(c)
    for x in target:
        t.update(slow_features(x, ngrams)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + BUCKETS) / ((s[b] + 1.0) * (big_t + BUCKETS)))) for b in s}
    out = []
    for i, c, words, n in found:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_against_brute_force(spark):
    documents, target = (pd.read_parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in resampling.op12_resampling(spark, SMALL).collect()), key=str)
    assert got == slow(zip(documents.doc_id, documents.text), target.text)
    assert sum(r[4] is not None for r in got) > 10


AWKWARD = [None, "", " \t\n", "One", "A-b c_d  e", "É é ß İ ǅ 日本 x", "tail  ", "\x00a\x7fb", "9 lives, 10 LIVES", "word " * 90_000, "a b " * 30, "a b " * 30]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_awkward_texts_and_longer_ngrams(spark, docs, ngrams):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(AWKWARD)] + [(10, AWKWARD[10])] * 2 + [(50 + i, "some common words " * 9) for i in range(40)]
    target = spark.createDataFrame([(1, "lives and common words"), (2, None), (3, "b a b")], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(docs(*rows), target, 30, ngrams).collect()), key=str)
    assert got == slow(rows, ["lives and common words", None, "b a b"], 30, ngrams)
    assert resampling.resample(docs(*rows).limit(0), target).count() == 0


def test_empty_target_and_drawn_rows(spark, docs):
    rows = [(i, f"w{i} " * 25) for i in range(50)]
    empty = spark.createDataFrame([], "text string")
    got = sorted((tuple(r) for r in resampling.resample(docs(*rows), empty).collect()), key=str)
    assert got == slow(rows, [])
    kept = resampling.drawn(docs(*rows), empty)
    assert kept.columns == docs(*rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[4])


def test_matches_start_and_end_at_words():
    two = resampling.scanners(2)[1]
    assert [m[0] for m in two.finditer(resampling.folded(b" Aa  bb-cc "), overlapped=True)] == [b"aa bb", b"bb cc"]
