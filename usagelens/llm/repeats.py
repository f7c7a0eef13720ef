"""Removal of repeated byte strings by a prefix-free parse of the corpus.

A byte of a text goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

**Parse.** A trigger is a position whose rolling hash (of ``WINDOW`` bytes) is the least among some ``GAP`` neighbours,
so triggers depend on content alone, equal strings are cut alike, and no phrase is longer than ``GAP`` steps. Each
string of ``LENGTH`` bytes belongs to the trigger that is least among its first ``GAP`` positions. It is therefore a
suffix of the phrase that ends in this trigger, followed by what the parse holds after it: the pair (suffix of a
dictionary phrase, suffix of the parse) whose order is the corpus order.

**Names instead of sorted ranks.** Only equality to a depth of ``LENGTH`` bytes is asked, so suffixes of dictionary and
parse carry names (hashes of their bytes) and classes of equal names stand for runs of the suffix array; a sorted array
would take a row for every byte of the dictionary. Two levels are enough:

1. per trigger: ``key``, the parse after it to the depth that all its strings share, and ``name``, phrase suffix and
   parse together to the depth that its strings reach. A key met once: none of its strings repeats. A name met twice: all
   of them do. A key with several names stays open.
2. per string of open triggers, one trigger for each different name: its own name of 96 bits, and whether it is met twice.

**Exchange.** Questions are dealt out by key, packed to one row per batch and bucket, and answered to the row they came
from. A batch asks once for equal questions and settles its own copies itself, so a name that a third of all rows
share reaches its bucket once per batch. Texts are compressed once; they move once, to be joined with the answers, and
those with open triggers a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import discard, stored, table

LENGTH = 200
WINDOW = 8
GAP = 80
DEPTH = LENGTH - GAP + 1
PER_PARTITION = 4
#: What is known of a trigger or a string.
REPEATED, OPEN, BOTH = 1, 2, 3
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
ROWS = 2048
_QUESTION = np.dtype([("key", "<u4"), ("name", "<u8"), ("row", "<i8"), ("at", "<u4")])
_KNOWN = np.dtype([("at", "<u4"), ("state", "u1")])
PACK = "bucket long, row long, content binary"
_PACK = pa.schema([("bucket", pa.int64()), ("row", pa.int64()), ("content", pa.binary())])


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of a text and the first and last start of the strings that belong to each; shorter texts have none."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 3
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), WINDOW)
    h = np.ascontiguousarray(view[: n - LENGTH + GAP]).view("<u8").ravel() * MIX1
    h ^= h >> np.uint64(29)
    h *= MIX2
    least = (h & HIGH) | np.arange(len(h), dtype=np.uint64)  # the first of equal hashes
    width = 1
    while width < GAP:
        step = min(width, GAP - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    trigger = (least & LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(trigger)) + 1
    first = np.concatenate([[0], cut])
    return trigger[first], first, np.concatenate([cut, [len(trigger)]]) - 1


def names(raw: bytes, triggers: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and name of each trigger."""
    digest, text = xxhash.xxh3_64_intdigest, memoryview(raw)
    found = zip(triggers.tolist(), first.tolist(), last.tolist())
    both = [(digest(text[u : u + DEPTH]), digest(text[a : b + LENGTH], u - a)) for u, a, b in found]
    return tuple(np.array(both, dtype=np.uint64).reshape(-1, 2).T)


def _string_names(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digest, text = xxhash.xxh3_128_intdigest, memoryview(raw)
    both = np.array([divmod(digest(text[i : i + LENGTH]), 1 << 64) for i in starts.tolist()], dtype=np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _packed(parts: int, row: np.ndarray, at: np.ndarray, key: np.ndarray, name: np.ndarray, twice: np.ndarray | None = None) -> pa.RecordBatch:
    """The questions of one batch: one for each (key, name), and what the batch can tell by itself.

    Rows with a negative ``bucket`` are answers already, keyed by ``row``. ``twice`` marks questions that are known to be
    repeated. A question is asked by the first row that has it.
    """
    order = np.lexsort((at, row, name, key))
    row, at, key, name = row[order], at[order], key[order], name[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    starts = np.flatnonzero(new)
    several = np.diff([*starts, len(key)]) > 1
    if twice is not None:
        several |= np.maximum.reduceat(twice[order], starts) if len(starts) else several
    told = np.repeat(several, np.diff([*starts, len(key)]))
    out = [(-1 - r % parts, r, c) for _, r, c in _answers(row[told], at[told], np.full(int(told.sum()), REPEATED, dtype=np.uint8))]
    first, bucket = starts, (key[starts] % np.uint64(parts)).astype(np.int64)
    asked = np.zeros(len(first), dtype=_QUESTION)
    asked["key"], asked["name"] = (key[first] >> np.uint64(32)).astype(np.uint32), name[first]
    asked["row"], asked["at"] = row[first], at[first]
    by = np.lexsort((asked["at"], asked["row"], bucket))
    bucket, asked = bucket[by], asked[by]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    cuts = [0, *edges.tolist(), len(asked)] if len(asked) else [0]
    rows = [(int(bucket[a]), None, _planes(asked[a:b])) for a, b in zip(cuts, cuts[1:])]
    return _batch(out + rows)


def _planes(asked: np.ndarray) -> bytes:
    """Questions byte by byte, so that the shuffle's compression meets runs of equal bytes."""
    return np.ascontiguousarray(asked.view(np.uint8).reshape(-1, _QUESTION.itemsize).T).tobytes()


def _questions(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(_QUESTION.itemsize, -1).T).view(_QUESTION).ravel()


def _answers(row: np.ndarray, at: np.ndarray, state: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(row, kind="stable")
    row = row[order]
    known = np.zeros(len(row), dtype=_KNOWN)
    known["at"], known["state"] = at[order], state[order]
    edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)] if len(row) else [0]
    return [(-1, int(row[a]), known[a:b].tobytes()) for a, b in zip(edges, edges[1:])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _PACK]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, _PACK)], schema=_PACK)


def _answered(packs: list[tuple[int, int, bytes]], by_name: bool) -> list[tuple[int, int, bytes]]:
    """Answers to the questions of whole buckets; ``by_name``: keys with several names are opened."""
    if not packs:
        return []
    asked = np.concatenate([_questions(c) for _, _, c in packs])
    sizes = [len(c) // _QUESTION.itemsize for _, _, c in packs]
    bucket = np.repeat([b for b, _, _ in packs], sizes)
    order = np.lexsort((asked["row"], asked["name"], asked["key"], bucket))
    asked, bucket = asked[order], bucket[order]
    new_key = np.ones(len(asked), dtype=bool)
    new_key[1:] = (asked["key"][1:] != asked["key"][:-1]) | (bucket[1:] != bucket[:-1])
    new_name = new_key.copy()
    new_name[1:] |= asked["name"][1:] != asked["name"][:-1]
    of_name, of_key = np.cumsum(new_name) - 1, np.cumsum(new_key) - 1
    state = np.where(np.bincount(of_name)[of_name] > 1, REPEATED, 0).astype(np.uint8)
    if by_name:
        different = np.bincount(of_key[new_name])
        state[new_name & (different[of_key] > 1)] |= OPEN  # the first of each name stands for it
    told = state > 0
    return _answers(asked["row"][told], asked["at"][told], state[told])


def _exchange(packs: DataFrame, by_name: bool) -> DataFrame:
    """Rows (row, known): all answers to a row, from its own batch and from the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            told = []
            for pack in zip(*(c.to_pylist() for c in batch.columns)):
                if pack[0] < 0:
                    told.append(pack)
                    continue
                if held and held[-1][0] != pack[0]:
                    told += _answered(held, by_name)
                    held = []
                held.append(pack)
            yield _batch(told)
        yield _batch(_answered(held, by_name))

    told = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACK)
    return told.groupBy("row").agg(F.array_join(F.collect_list(F.hex("content")), "").alias("known"))


def _known(raw: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and their states, each position once."""
    found = np.frombuffer(bytes.fromhex(raw or ""), dtype=_KNOWN)
    at, inverse = np.unique(found["at"].astype(np.int64), return_inverse=True)
    state = np.zeros(len(at), dtype=np.uint8)
    np.bitwise_or.at(state, inverse, found["state"])
    return at, state


def _parts(spark: SparkSession) -> int:
    return PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _held(documents: DataFrame) -> DataFrame:
    """The texts, compressed, with numbers for rows: row, doc_id, text. Stored, so that numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = pa.array([pack.compress(t.as_py() or b"") for t in part.column(2)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], texts], names=["row", "doc_id", "text"])

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return stored(numbered.mapInArrow(run, "row long, doc_id long, text binary"), "texts")


def _ask_triggers(held: DataFrame) -> DataFrame:
    parts = _parts(held.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = []
                for row, text in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)):
                    raw = unpack(text)
                    cut = parse(raw)
                    found.append((np.full(len(cut[0]), row), cut[0], *names(raw, *cut)))
                if found:
                    yield _packed(parts, *map(np.concatenate, zip(*found)))

    return held.select("row", "text").mapInArrow(run, PACK)


def _ask_strings(opened: DataFrame) -> DataFrame:
    """Questions on all strings of the open triggers."""
    parts = _parts(opened.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = []
                for row, text, known in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)):
                    raw = unpack(text)
                    at, state = _known(known)
                    open_ = state & OPEN > 0
                    triggers, first, last = parse(raw)
                    place = np.searchsorted(triggers, at[open_])
                    width = last[place] - first[place] + 1
                    starts = np.repeat(first[place] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                    sure = np.repeat(state[open_] & REPEATED > 0, width)
                    found.append((np.full(len(starts), row), starts, *_string_names(raw, starts), sure))
                if found:
                    yield _packed(parts, *map(np.concatenate, zip(*found)))

    return opened.select("row", "text", "known").mapInArrow(run, PACK)


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals [start, end); touching ones are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])].tolist()))


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]])


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_DONE = "doc_id long, n_bytes long, spans array<struct<first: int, end: int>>, kept_sha256 string"


def _done(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    return len(raw), [{"first": a, "end": b} for a, b in spans], hashlib.sha256(kept(raw, spans)).hexdigest()


def _settle(joined: DataFrame) -> DataFrame:
    """Texts with the answers on their triggers: finished rows (``row`` is NULL), and open ones with what they need."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept_sha256", pa.string())]
    fields += [("row", pa.int64()), ("text", pa.binary()), ("known", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                out = []
                for row, doc_id, text, known in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)):
                    raw = unpack(text)
                    at, state = _known(known)
                    settled = []
                    if len(at):
                        triggers, first, last = parse(raw)
                        whole = np.searchsorted(triggers, at[state & REPEATED > 0])
                        settled = spans_of(first[whole], last[whole] + LENGTH)
                    done = _done(raw, settled)
                    if (state & OPEN).any() and settled != [(0, len(raw))]:
                        out.append((doc_id, *done[:2], None, row, text, known))
                    elif (state & OPEN).any():  # all of it goes, but others ask for its strings
                        out.append((doc_id, *done, row, text, known))
                    else:
                        out.append((doc_id, *done, None, None, None))
                columns = zip(*out) if out else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return stored(joined.mapInArrow(run, _DONE + ", row long, text binary, known string"), "settled")


def _finish(opened: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                out = []
                for doc_id, settled, text, known in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)):
                    at, state = _known(known)
                    at = at[state & REPEATED > 0]
                    starts = np.array([s["first"] for s in settled] + at.tolist(), dtype=np.int64)
                    ends = np.array([s["end"] for s in settled] + (at + LENGTH).tolist(), dtype=np.int64)
                    out.append((doc_id, *_done(unpack(text), spans_of(starts, ends))))
                kinds = (pa.int64(), pa.int64(), _SPANS, pa.string())
                columns = zip(*out) if out else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "spans", "kept_sha256"])

    return opened.select("doc_id", "spans", "text", "known").mapInArrow(run, _DONE)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, spans (of removed bytes, end exclusive), kept_sha256.

    Texts are their UTF-8 bytes; NULL is empty. Texts of fewer than ``LENGTH`` bytes keep everything; equal texts of at
    least that length keep nothing. NULL and repeated ids are rows like any other. Other columns are ignored. An empty
    table gives no rows.
    """
    held = _held(documents)
    answers = _exchange(_ask_triggers(held), by_name=True)
    settled = _settle(held.join(answers, "row", "left").select("row", "doc_id", "text", "known"))
    discard(held)
    finished = settled.where("kept_sha256 IS NOT NULL").select("doc_id", "n_bytes", "spans", "kept_sha256")
    again = _exchange(_ask_strings(settled.where("row IS NOT NULL")), by_name=False)
    opened = settled.where("kept_sha256 IS NULL").drop("known").join(again, "row", "left")
    return finished.unionAll(_finish(opened))


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with ``text`` replaced by the remaining bytes (binary, as a cut may fall inside a character)."""
    keys = [F.col("doc_id").cast("long").alias("_id"), "n_bytes", "spans"]
    held = stored(documents.withColumn("_key", F.monotonically_increasing_id()), "texts")
    found = repeated_spans(held.select(F.col("_key").alias("doc_id"), "text")).select(*keys)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    edges = F.expr("transform(sequence(0, size(spans)), i -> struct(if(i = 0, 0, spans[i - 1].end) AS a, if(i = size(spans), n_bytes, spans[i].first) AS b))")
    cut = F.aggregate(edges, F.lit(b""), lambda out, e: F.concat(out, F.substring(raw, e.a + 1, (e.b - e.a).cast("int"))))
    return held.join(found, F.col("_key") == F.col("_id")).withColumn("text", cut).select(*documents.columns)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s.end - s.first))
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
