import numpy as np
import pandas as pd
import pytest
import xxhash

from tests.conftest import SMALL
from usagelens.llm import simhash
from usagelens.llm.shared import components


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 2)[0] + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", "  \n", "One", "two words", "A b\tC\x0bd  É é", "x " * 70_000, "ß Ǆ İ " * 5])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_query_against_all_pairs(spark):
    got = simhash.op9_simhash(spark, SMALL).toPandas().sort_values("doc_id")
    table = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    prints = [slow_print(t or "") for t in table.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == slow_components(table.doc_id.tolist(), prints)


def test_links_are_exact_with_hot_parts(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist()) | {0, 1, 3, 7}
    for b in base:  # chains of small steps and a crowd that shares most bits
        for _ in range(6):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                b ^= np.uint64(1) << np.uint64(bit)
            prints.add(int(b))
    prints |= {int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    values = np.array(sorted(prints), dtype=np.uint64)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": values.view(np.int64)}))
    for parts in (2, 3):
        got = {(r.a, r.b) for r in simhash.links(nodes, parts=parts).collect()}
        signed = values.view(np.int64)
        want = set()
        for i in range(len(values)):
            for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2)[0] + i + 1:
                want.add((min(int(signed[i]), int(signed[j])), max(int(signed[i]), int(signed[j]))))
        assert got == want


def test_thresholds_sum_and_are_cheapest():
    rng = np.random.default_rng(2)
    costs = [np.concatenate([np.zeros((50, 1)), np.sort(rng.integers(1, 99, (50, 3)), axis=1)], axis=1) for _ in range(3)]
    chosen = simhash.allocate(costs, 0)
    assert (chosen.sum(axis=1) == 0).all()
    for i in range(50):
        options = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
        cost = lambda t: sum(costs[k][i, t[k] + 1] for k in range(3))  # noqa: B023, E731
        assert cost(chosen[i]) == min(map(cost, options))


def test_edge_cases(spark, docs):
    frame = docs((5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "only here"), (12, "z" * 200_000), (13, "q r s"), (4, "q r s"))
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert rows == {(5, 3), (3, 3), (9, 9), (None, 9), (None, None), (12, 12), (13, 4), (4, 4)}
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "3", "4", "9", "None"]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 == simhash.one_of_each(frame.limit(0)).count()


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101), (102, 101), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
