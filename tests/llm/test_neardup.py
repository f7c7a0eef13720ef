import random

import numpy as np
import pandas as pd
import pytest

from usagelens.llm import neardup, simhash
from usagelens.llm.shared import table


def slow_groups(rows):
    """Component ids by brute force over all pairs of five-word shingle sets."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return {doc_id: lowest[find(i)] for i, (doc_id, _) in enumerate(rows)}


def test_stage_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(d, t) for d, t in pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    want = slow_groups(rows)
    docs = table(spark, folder, "documents")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want
    kept = simhash.stage(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("rounds", [0, 2])
def test_chains_crowds_and_common_passages(spark, docs, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    common = " ".join(word() for _ in range(20))
    rows = [(900, None), (901, "  "), (902, "two words"), (903, "Two\nWORDS"), (904, "two word")]
    for i in range(4):  # chains: each text differs from the last by one word
        text = [word() for _ in range(rng.randint(20, 90))]
        for k in range(25):
            rows.append((100 * i + k, " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    rows += [(500 + k, common + " " + " ".join(word() for _ in range(rng.randint(2, 12)))) for k in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(*rows)).collect()}
    assert got == slow_groups(rows)


def test_repeated_and_missing_ids(spark, docs):
    frame = docs((5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "only here"), (13, "q r s"), (4, "q r s"))
    kept = simhash.stage(spark, frame, "")
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "9", "None"]
    assert simhash.stage(spark, frame.limit(0), "").count() == 0


def test_candidates_come_from_simhash_first(spark, docs):
    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = [" ".join([*text, *(f"tail{k}{i}" for i in range(3))]) for k in range(6)]
    rows = list(enumerate([*near, " ".join(f"x{i}" for i in range(50)), None, ""]))
    sets = neardup._sets(docs(*rows)).collect()
    for row, (_, body) in zip(sorted(sets, key=lambda r: r.doc_id), rows):
        assert row.fp & (1 << 64) - 1 == simhash.fingerprint((body or "").encode(), neardup.WORDS)
    node = {r.doc_id: r.node for r in sets}
    fp = {r.node: r.fp & (1 << 64) - 1 for r in sets}
    pairs = {(r.a, r.b) for r in neardup.print_pairs(neardup._sets(docs(*rows))).collect()}
    assert pairs and all((fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS for a, b in pairs)
    linked = {n for p in pairs for n in p}
    for i in range(6):
        close = any(i != j and (fp[node[i]] ^ fp[node[j]]).bit_count() <= simhash.RADIUS for j in range(6))
        assert (node[i] in linked) == close


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 700, 5000])
def test_bitmaps_never_exceed_the_difference(n):
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    for share in (0.0, 0.05, 0.3, 1.0):
        fresh = rng.integers(0, 2**64, int(share * n), dtype=np.uint64)
        other = np.unique(np.concatenate([base[rng.random(len(base)) >= share], fresh]))
        differ = len(np.setxor1d(base, other))
        assert neardup.apart(neardup.signature(base), neardup.signature(other)) <= differ
        if n >= 700 and share == 1.0:  # and it refutes unlike sets
            assert 9 * neardup.apart(neardup.signature(base), neardup.signature(other)) > len(base) + len(other)
