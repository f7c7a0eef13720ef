"""Near-duplicate texts: SimHash candidates first, completed to the exact Jaccard similarity of word shingles.

A text is the set of its shingles of ``WORDS`` words (lower-cased as for ``simhash``; a shorter text is one shingle).
Texts whose sets have a similarity of at least ``NUM / DEN`` are linked, and a document's component is the smallest
``doc_id`` it reaches. Texts with equal sets are one node.

The first candidates are SimHash's: nodes whose fingerprints, voted by the same shingles, differ in at most
``simhash.RADIUS`` bits, found by the pigeonhole search of ``simhash.links``. Every candidate is verified on the whole sets.

Similar texts can lie further apart than any radius that can be searched, so a second search loses no link (prefix
filtering). All shingles have one global order, those frequent in a bounded sample last; two sets of that similarity share
a shingle among the first ``n - ceil(s n) + 1`` of each, and the first one they share stands early enough in both that the
overlap can still be reached. The sample only steers how many candidates there are.

Before whole sets are fetched, candidates are compared by parity bitmaps of about a bit a shingle: a shingle in only one of
two sets flips one bit, so two sets differ in at least as many shingles as their bitmaps in bits. This refutes most
candidates and never a link. The first rounds compare the holders of a shingle with one hub of that
shingle only, so a crowd of near copies takes as many comparisons as it has members; the last round compares all pairs
that still lie in different components. Pairs within one component need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm import simhash
from usagelens.llm.shared import components, discard, release, stored

WORDS = 5
NUM, DEN = 4, 5  # similarity 0.8
HUB_ROUNDS = 2
SAMPLE = 20_000
FREQUENT = 200_000
FEW = 2_000_000
ROWS = 512


def distinct(blocks: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes of the blocks of ``simhash.shingle_hashes``."""
    return np.unique(np.concatenate(blocks).astype(np.uint64)) if blocks else np.zeros(0, dtype=np.uint64)


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of a UTF-8 text; no words give none."""
    return distinct(list(simhash.shingle_hashes(raw, words)))


def signature(hashes: np.ndarray) -> bytes:
    """Parity bitmap of a set: a power of two of bits, at least as many as hashes and at least 64."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A number of hashes in which the sets of two signatures differ at least; the longer one is folded to the shorter."""
    x, y = sorted((np.frombuffer(s, dtype=np.uint64) for s in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_node(hashes: np.ndarray) -> int:
    """The node of a set as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _frequent(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes met in several texts of a sample, sorted, and their counts; bounds work, not results."""
    share = max(1, documents.count() // SAMPLE)
    key = F.xxhash64("text")
    texts = documents.select(key.alias("k"), F.col("text").cast("binary").alias("text")).where(F.pmod(F.xxhash64(F.lit(7), "k"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the stage before kept
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = [shingles(text.as_py() or b"") for text in batch.column(1).slice(k, ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["hash"])

    top = (
        texts.dropDuplicates(["k"]).mapInArrow(run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
        .orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    )
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _sets(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, node, n, fp, sign, keys): ``fp`` is the SimHash fingerprint of the shingles, ``sign`` the
    parity bitmap of their set and ``keys`` the prefix of the set in the global order."""
    shared = documents.sparkSession.sparkContext.broadcast(_frequent(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the stage before kept
        common, counts = shared.value
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            hashed = [list(simhash.shingle_hashes(text.as_py() or b"", WORDS)) for text in batch.column(2)]
            prints = np.array([simhash.voted(blocks) for blocks in hashed], dtype=np.uint64).view(np.int64)
            sets = [distinct(blocks) for blocks in hashed]
            keys = []
            for found in sets:
                n = len(found)
                first = n - -(-NUM * n // DEN) + 1 if n else 0
                at = np.searchsorted(common, found)
                rank = np.zeros(n, dtype=np.int64)
                if len(common):
                    met = common[np.minimum(at, len(common) - 1)] == found
                    rank[met] = counts[at[met]]
                keys.append(found[np.argsort(rank, kind="stable")[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array([set_node(s) for s in sets], type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int32()),
                    pa.array(prints), pa.array([signature(s) for s in sets], type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "node", "n", "fp", "sign", "keys"],
            )

    narrow = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))
    return stored(narrow.mapInArrow(run, "doc_id long, text_key long, node long, n int, fp long, sign binary, keys array<long>"), "sets")


def _hashes(documents: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, hashes) of the wanted nodes: the whole sets, made again from one text of each."""
    chosen = sets.select("node", "text_key").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    texts = documents.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = [shingles(text.as_py() or b"") for text in batch.column(0).slice(k, ROWS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_node(s) for s in found], type=pa.int64()), pa.array([s.tobytes() for s in found], type=pa.binary())],
                    names=["node", "hashes"],
                )

    # copies of a text are one: of a large group of copies a task sends one set
    own = texts.join(_small(chosen.select("text_key").distinct(), "chosen"), "text_key", "left_semi").select("text")
    return stored(own.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), "held")


def _may(a: str, b: str) -> Column:
    """Whether sets that share this key first can be similar: by their sizes and by what follows the key."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & ((NUM + DEN) * rest >= NUM * (na + nb))


def _small(numbers: DataFrame, label: str) -> DataFrame:
    """A one-column frame for a semi join: broadcast if it has at most ``FEW`` numbers, else joined by a shuffle."""
    found = stored(numbers, label)
    return F.broadcast(found) if found.count() <= FEW else found


def _may_by_sign(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that sizes and parity bitmaps leave possible."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, left, right = (batch.column(c).to_pylist() for c in (2, 3, 4))
            possible = [(NUM + DEN) * apart(x, y) <= (DEN - NUM) * n for n, x, y in zip(total, left, right)]
            yield batch.select([0, 1]).filter(pa.array(possible, type=pa.bool_()))

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))
    return both.select("a", "b", F.col("na") + F.col("nb"), "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(candidates: DataFrame, nodes: DataFrame, sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar, stored."""
    pairs = stored(_may_by_sign(candidates, nodes), "candidates")
    wanted = _small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    held = _hashes(documents, sets, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: (np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(c))  # noqa: B023, E731
            yield batch.select([0, 1]).filter(pa.array([similar(x, y) for x, y in zip(of(2), of(3))], type=pa.bool_()))

    first = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = first.join(held.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    found = stored(both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"), "similar")
    discard(pairs, held)
    return found


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by their SimHash fingerprints: a hub stands for the nodes of an equal fingerprint, and is
    paired with them and with the hubs of the fingerprints within ``simhash.RADIUS`` bits."""
    hubs = stored(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "prints")
    equal = nodes.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    of = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}"))
    near = simhash.links(hubs).join(of("a"), "a").join(of("b"), "b").select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))
    return equal.unionAll(near)


def links(sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are similar, enough to connect every component; ``sets`` as stored by ``_sets`` for ``documents``."""
    nodes = stored(sets.groupBy("node", "n").agg(F.first("fp").alias("fp"), F.first("sign").alias("sign"), F.first("keys").alias("keys")), "nodes")
    entries = nodes.select("node", "n", F.posexplode_outer("keys").alias("pos", "key")).where("key IS NOT NULL")
    shared = _small(entries.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("key"), "keys")
    entries = stored(entries.join(shared, "key", "left_semi"), "entries")
    edges = _verified(print_pairs(nodes), nodes, sets, documents)
    for turn in range(HUB_ROUNDS + 1):
        members = stored(components(edges), "members")
        placed = stored(entries.join(members, "node", "left").select("node", "n", "pos", "key", F.coalesce("root", "node").alias("comp")), "placed")
        # what is left: keys whose holders lie in several components
        open_keys = placed.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.min_by(F.struct("node", "n", "pos", "comp"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("hub"),
        ).where("low <> high")
        if turn < HUB_ROUNDS:
            other = open_keys.select("key", "hub.*")
        else:
            other = placed.join(open_keys.select("key"), "key", "left_semi")
        differ = (F.col("e.comp") != F.col("o.comp")) if turn < HUB_ROUNDS else (F.col("e.comp") < F.col("o.comp"))
        pairs = (
            placed.alias("e").join(other.alias("o"), F.col("e.key") == F.col("o.key")).where(differ & _may("e", "o"))
            .select(F.least("e.node", "o.node").alias("a"), F.greatest("e.node", "o.node").alias("b")).distinct()
        )
        edges = edges.unionAll(_verified(pairs, nodes, sets, documents))
        discard(members, placed)
    return edges


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``documents``; ``fingerprint`` is the set's node in hexadecimal.

    NULL and texts without words are one component. NULL ids never become a component id; a component without any id
    has a NULL one. Repeated rows give repeated rows. Other columns are ignored. An empty table gives no rows.
    """
    sets = _sets(documents)
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("lowest"))
    members = components(links(sets, documents)).withColumnRenamed("node", "member")
    rooted = nodes.join(members, nodes.node == members.member, "left").select("node", "lowest", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    of_node = rooted.join(lowest, "root").select("node", "component_id")
    return sets.select("doc_id", "node").join(of_node, "node").select(
        "doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id"
    )


def text_print(raw: bytes) -> str:
    return f"{set_node(shingles(raw)) & (1 << 64) - 1:016x}"
