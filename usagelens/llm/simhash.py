"""SimHash near-duplicates with a generalised pigeonhole search.

A text is lower-cased (A-Z), cut into words at ASCII white space and into shingles of ``WORDS`` words; each shingle,
repeats included, votes with its XXH64 on every bit of the 64-bit fingerprint. Fingerprints within ``RADIUS`` bits are
linked and a document's component is the smallest ``doc_id`` it reaches.

The search for linked fingerprints is exact. The 64 bits are split into ``PARTS`` groups of correlated bits. By the
general pigeonhole principle, two fingerprints within ``RADIUS`` bits agree on some group ``i`` within ``t_i`` bits
whenever the thresholds ``t_i >= -1`` sum to ``RADIUS - PARTS + 1`` (-1: the group is not probed). Every fingerprint
picks its own thresholds by dynamic programming over estimated candidate counts, so it avoids the groups in which its
value is common; it then probes all values within ``t_i`` bits and the candidates are verified on all 64 bits.

Nothing but a bounded sample of fingerprints (to group the bits, ``SAMPLE`` rows) and a count sketch of fixed size
reaches the driver. For hundreds of millions of distinct fingerprints use ``parts=2``: wider groups, more probes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from usagelens.llm.shared import components, small_batches, stored, table

WORDS = 3
RADIUS = 2
PARTS = 3
SAMPLE = 20_000
SEED = 42
SKETCH_BITS = 16
SHINGLE_BLOCK = 1 << 16


def shingle_hashes(raw: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one UTF-8 text, repeats included, in blocks of big-endian numbers; no words give none."""
    found = raw.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
    if not found:
        return
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda end, n: end + 1 + n))
    last = ends[words - 1 :] or ends[-1:]
    starts = [0, *(end + 1 for end in ends[: len(last) - 1])]
    digest = xxhash.xxh64_digest
    for k in range(0, len(last), SHINGLE_BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SHINGLE_BLOCK], last[k:])])
        yield np.frombuffer(hashes, dtype=">u8")


def voted(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint that blocks of shingle hashes vote for, as an unsigned integer; no hashes give zero."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer; no words give zero."""
    return voted(shingle_hashes(raw, words))


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row (doc_id, fp) per document; ``fp`` is the fingerprint as a signed long. NULL texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint(text.as_py() or b"", words) for text in batch.column(1)], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """All 64 bits in ``parts`` groups of near-equal size, bits that vary together in the same group."""
    bits = (sample.astype(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    spread = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, 64))
    scale = np.sqrt((spread**2).sum(axis=0))
    alike = np.abs(spread.T @ spread) / np.maximum(np.outer(scale, scale), 1e-9)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (alike[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (alike[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _value(fp: Column, group: list[int]) -> Column:
    """The bits of a group, packed into one integer."""
    return reduce(
        Column.bitwiseOR,
        [F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k) for k, b in enumerate(group)],
    )


def _key(part: int, value: Column) -> Column:
    return F.lit(part << 40).cast("long").bitwiseOR(value)


#: Spreads group values over the sketch; the same product in numpy and in Spark.
_MIX, _MASK = 2654435761, (1 << 32) - 1


def _sketch_slot(values: np.ndarray) -> np.ndarray:
    folded = (values ^ (values >> 24)) & 0x1FFFFFFF
    return ((folded * _MIX) & _MASK) >> (32 - SKETCH_BITS)


def _sketch_column(value: Column) -> Column:
    folded = value.bitwiseXOR(F.shiftrightunsigned(value, 24)).bitwiseAND(F.lit(0x1FFFFFFF).cast("long"))
    return F.shiftrightunsigned((folded * F.lit(_MIX)).bitwiseAND(F.lit(_MASK)), 32 - SKETCH_BITS)


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Cheapest thresholds (rows x parts) that sum to ``total``; ``costs[i][:, t + 1]`` is the cost of threshold t.

    Dynamic programming over the parts, for all rows at once.
    """
    rows, parts = len(costs[0]), len(costs)
    low = [-k for k in range(parts + 1)]
    best: dict[int, np.ndarray] = {0: np.zeros(rows)}
    picks: list[dict[int, np.ndarray]] = []
    for i, cost in enumerate(costs):
        nxt, pick = {}, {}
        sums = {s + t for s in best for t in range(-1, cost.shape[1] - 1)}
        for s in sorted(x for x in sums if x >= low[i + 1] and x - (parts - i - 1) <= total):
            options = [(t, best[s - t] + cost[:, t + 1]) for t in range(-1, cost.shape[1] - 1) if s - t in best]
            stacked = np.stack([c for _, c in options])
            at = stacked.argmin(axis=0)
            nxt[s] = stacked[at, np.arange(rows)]
            pick[s] = np.array([t for t, _ in options])[at]
        best = nxt
        picks.append(pick)
    chosen, left = np.zeros((rows, parts), dtype=np.int64), np.full(rows, total)
    for i in reversed(range(parts)):
        for s, pick in picks[i].items():
            here = left == s
            chosen[here, i] = pick[here]
        left = left - chosen[:, i]
    return chosen


def _flips(width: int, t: int) -> np.ndarray:
    """Masks of all values within t bits."""
    return np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(width), n)], dtype=np.int64)


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` of ``nodes`` that differ in at most ``radius`` bits."""
    spark = nodes.sparkSession
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy()
    groups = bit_groups(sample, parts)
    index = nodes.select(
        "fp", F.explode(F.array(*[_key(i, _value(F.col("fp"), g)) for i, g in enumerate(groups)])).alias("key")
    )
    value = F.col("key").bitwiseAND(F.lit((1 << 40) - 1))
    counts = (
        index.groupBy(F.shiftright("key", 40).cast("int").alias("part"), _sketch_column(value).cast("int").alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
        .toArrow()
    )
    sketch = np.zeros((parts, 1 << SKETCH_BITS))
    sketch[counts["part"].to_numpy(), counts["slot"].to_numpy()] = counts["n"].to_numpy()
    shared = spark.sparkContext.broadcast(sketch)
    total, masks = radius - parts + 1, [[_flips(len(g), t) for t in range(radius + 1)] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(k, 8192).to_numpy().view(np.uint64)
                values = [
                    sum((((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(n) for n, b in enumerate(g)), np.uint64(0)).astype(np.int64)
                    for g in groups
                ]
                costs = []
                for i in range(parts):
                    near = [shared.value[i][_sketch_slot(values[i][:, None] ^ m[None, :])].sum(axis=1) + len(m) for m in masks[i]]
                    costs.append(np.stack([np.zeros(len(fp)), *near], axis=1))
                chosen = allocate(costs, total)
                out_fp, out_key = [], []
                for i in range(parts):
                    for t, m in enumerate(masks[i]):
                        here = chosen[:, i] == t
                        out_fp.append(np.repeat(fp[here], len(m)))
                        out_key.append(((values[i][here][:, None] ^ m[None, :]) | (i << 40)).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_fp).view(np.int64)), pa.array(np.concatenate(out_key))], names=["probe", "key"]
                )

    probes = nodes.select("fp").mapInArrow(run, "probe long, key long")
    apart = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp")))
    return (
        probes.join(index, "key")
        .where((F.col("probe") != F.col("fp")) & (apart <= radius))
        .select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))
        .distinct()
    )


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``documents`` (doc_id, text; other columns are ignored).

    Equal fingerprints are one node, whatever their number; links are sought between distinct fingerprints only.
    NULL and empty texts have fingerprint zero and are linked like any other. NULL ids never become a component id; a
    component without any id has a NULL one. Repeated rows give repeated rows. An empty table gives no rows.
    """
    rows = stored(fingerprints(documents, words), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    members = components(links(nodes, radius, parts))
    rooted = nodes.join(members, nodes.fp == members.node, "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    of_print = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that stand for their component: those with its smallest id.

    Of rows that repeat an id within a component one stays; in components without any id one row of each fingerprint.
    """
    return standing_for(documents, near_duplicates(documents), lambda raw: f"{fingerprint(raw):016x}")


def standing_for(documents: DataFrame, found: DataFrame, print_of: Callable[[bytes], str]) -> DataFrame:
    """``one_of_each`` for any components ``found`` (doc_id, fingerprint, component_id) with the fingerprints ``print_of``."""
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(
        first.groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("component_id"))
        .groupBy("doc_id", "component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("own_print"))
        .agg(F.min("fingerprint").alias("kept_print"), F.sum("n").alias("n"))
        .select(F.col("doc_id").alias("kept_id"), "kept_print", "n"),
        "kept",
    )
    once, more = kept.where("n = 1 AND kept_id IS NOT NULL"), kept.where("n > 1 OR kept_id IS NULL")
    own = documents["doc_id"].cast("long")
    rows = documents.join(once, own == once["kept_id"], "left_semi")
    if more.isEmpty():
        return rows
    # repeated or missing ids: told apart by their fingerprints, one row for each
    repeated = documents.join(more, own.eqNullSafe(more["kept_id"]), "left_semi").select(F.struct("*").alias("row"))
    printed = fingerprints_beside(repeated, print_of)
    return rows.unionAll(
        printed.join(more, F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("print") == F.col("kept_print")), "left_semi")
        .groupBy(F.col("row.doc_id").alias("k"), "print").agg(F.any_value("row").alias("row")).select("row.*")
    )


def fingerprints_beside(rows: DataFrame, print_of: Callable[[bytes], str]) -> DataFrame:
    """Add ``print`` (hexadecimal) to a frame with a struct ``row`` that has a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text")
            prints = [print_of((t.as_py() or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, type=pa.string())], names=["row", "print"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("print", StringType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of at least 0.8."""
    from usagelens.llm import neardup  # which builds on this module

    small_batches(spark)
    return standing_for(docs, neardup.near_duplicates(docs), neardup.text_print)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
