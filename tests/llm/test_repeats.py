import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from usagelens.llm import repeats
from usagelens.llm.repeats import LENGTH


def slow(texts):
    """Rows (n_bytes, n_removed, n_spans, kept_sha256) from counts of all strings."""
    raws = [(t or "").encode() for t in texts]
    met = Counter(raw[i : i + LENGTH] for raw in raws for i in range(len(raw) - LENGTH + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - LENGTH + 1):
            if met[raw[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[min(i + LENGTH, len(raw))] -= 1
        covered = np.cumsum(gone)[: len(raw)] > 0
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows(frame):
    length = "aggregate(spans, 0L, (n, s) -> n + s.end - s.first)"
    return frame.selectExpr("doc_id", "n_bytes", f"{length} AS n_removed", "size(spans) AS n_spans", "kept_sha256").collect()


def test_query_against_counts_of_all_strings(spark):
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op11_repeats(spark, SMALL).collect()}
    assert got == dict(zip(table.doc_id, slow(table.text)))
    assert any(r[1] and r[1] < r[0] for r in got.values())


def _awkward():
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice(k) for _ in range(rng.randint(1, 9)))
    prose = lambda n, k="abcdefgh": " ".join(word(k) for _ in range(n))
    passage, licence = prose(90), prose(60, "ñé日x")
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 5000, "ab" * 900, "b" + "ab" * 150, "\n" * 450]
    texts += [prose(40) + passage[i : 400 + i % 50] + prose(30) for i in range(0, 60, 3)]  # starts and ends differ
    texts += [prose(rng.randint(0, 5)) + licence + prose(rng.randint(0, 5)) for _ in range(40)]
    texts += [passage] * 3 + [passage[:200], passage[100:301], licence + licence]
    base = prose(300)
    for k in range(25):  # near copies with an edit at each place
        at = 37 * k + 150
        texts.append(base[:at] + "#" * (k % 3) + base[at + 1 :])
    texts += [base[:x] for x in (199, 200, 201, 279, 280, 281)] + [base[-x:] for x in (200, 333)]
    texts += [prose(200, "ab") for _ in range(6)]
    return texts


@pytest.mark.parametrize("tasks", [1, 7])
def test_awkward_texts(spark, docs, tasks):
    texts = _awkward()
    frame = docs(*((i if i % 11 else None, t) for i, t in enumerate(texts))).repartition(tasks)
    want = sorted(((i if i % 11 else -1), *r) for i, r in enumerate(slow(texts)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in rows(repeats.repeated_spans(frame)))
    assert got == want
    assert repeats.repeated_spans(frame.limit(0)).count() == 0


def test_hot_group_and_kept_bytes(spark):
    frame = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('a copy of the same words, ', 12) ELSE concat(repeat(concat(id, ' own '), 5), repeat('shared line of text; ', 13), id) END AS text"
    )
    got = rows(repeats.repeated_spans(frame))
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(zip(texts, slow(texts.values())))
    left = repeats.without_repeats(frame)
    assert left.columns == frame.columns
    assert {r.doc_id: hashlib.sha256(r.text).hexdigest() for r in left.collect()} == {r.doc_id: r.kept_sha256 for r in got}


def test_each_string_has_one_trigger_that_depends_on_it_alone():
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 101, 3000, dtype=np.uint8)) + b"z" * 700
    trigger, first, last = repeats.parse(raw)
    assert first[0] == 0 and last[-1] == len(raw) - LENGTH and (first[1:] == last[:-1] + 1).all()
    assert (trigger >= last).all() and (trigger - first < repeats.GAP).all()
    for u, a, b in list(zip(trigger, first, last))[::7]:
        for i in {a, b}:
            assert repeats.parse(raw[i : i + LENGTH])[0].tolist() == [u - i]


def test_spans_are_maximal():
    f = lambda *s: repeats.spans_of(np.array([a for a, _ in s]), np.array([b for _, b in s]))
    assert f() == [] and f((5, 9), (0, 5), (20, 30), (21, 22), (29, 40)) == [(0, 9), (20, 40)]
    assert repeats.kept(b"0123456789", [(0, 2), (5, 9)]) == b"2349"
