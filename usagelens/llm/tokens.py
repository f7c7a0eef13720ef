"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned and sorted by ``doc_id``, encoded once, and written as one stream of ids per partition:
every document's ids and an end id. The stream is cut into equal-length sequences. A part is two Arrow IPC files:

* ``part-N.arrow``: columns ``ids`` (fixed_size_list[LENGTH], uint16 where the vocabulary allows, else uint32) and
  ``mask`` (fixed_size_list[LENGTH] of bool, false on the padding of the last sequence). Record batches hold ``BATCH``
  sequences and are not compressed, so token i of a part is in batch ``i // (LENGTH * BATCH)`` at a fixed offset and a
  reader can map the file and slice it without copying;
* ``part-N.docs.arrow``: ``doc_id``, ``at`` (index of the first id within the part) and ``n_tokens``.

Files get temporary names and are moved to their final ones when complete; a repeated task writes equal files. The
manifest (Parquet, one row per part) is written last, and only parts it lists count. Folders are reached with
``pyarrow.fs``: local or mounted paths, ``s3://``, ``gs://``, and ``hdfs://`` where libhdfs is installed.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usagelens.llm.shared import kept, new_folder, publish, small_batches, store, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
LENGTH = 2048
BATCH = 256
CACHE, KEPT = 400_000, 200_000
TOGETHER = 512
ROWS = 64

#: What the vocabulary's pre-tokenizer does, for texts of Latin letters only: a piece never depends on its neighbours.
_LATIN = [chr(c) for c in range(0x20, 0x250) if unicodedata.category(chr(c))[0] in "LNPSZ" and c != 0xA0] + ["\t", "\n", "\r"]
_class = lambda kind: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] in kind)
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^\\s{_class('LN')}]+|\\s+(?!\\S)|\\s+"
)
_WORD = re.compile(f" [{_class('L')}]+")  # next to another such piece, still a piece of its own
_OTHER = re.compile(f"[^{''.join(re.escape(c) for c in _LATIN)}]")


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes.

    The library splits a text into pieces and encodes each by itself, so the ids of a piece are remembered (at most
    ``CACHE`` between calls; of these the first ``KEPT``, most of them common, outlive a clean-up) and only new pieces are
    encoded, words up to ``TOGETHER`` in one text; the bytes of the tokens tell where each word's ids end. A text with a
    character outside the Latin range, or with the text of a special token, goes through the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # a character of a token stands for a byte
        for token, at in self.tokenizer.get_vocab().items():
            self.width[at] = len(token)
        self.known: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype=self.kind).tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn(self, pieces: list[str]) -> None:
        words, rest = [], []
        for p in pieces:
            (words if _WORD.fullmatch(p) else rest).append(p)
        if words:
            texts = ["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            bytes_to, word_ends = np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) for w in words])
            ends = np.searchsorted(bytes_to, word_ends) + 1
            if ends[-1] == len(ids) and np.array_equal(bytes_to[ends - 1], word_ends):
                raw, size = ids.tobytes(), self.kind.itemsize
                cuts = (size * ends).tolist()
                self.known.update((w, raw[a:b]) for w, a, b in zip(words, [0, *cuts], cuts))
            else:  # not a vocabulary of bytes
                rest += words
        if rest:
            self.known.update(zip(rest, self._direct(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not (_OTHER.search(t) or self.special and self.special.search(t)) for t in texts]
        pieces = [_PIECES.findall(t) if p else [] for t, p in zip(texts, plain)]
        if len(self.known) > CACHE:
            self.known = dict(islice(self.known.items(), KEPT))
        needed = set().union(*pieces)
        self._learn(sorted(needed.difference(self.known)))
        here = {p: self.known[p] for p in needed}  # small, so quick to look up
        return [b"".join(map(here.__getitem__, found)) if p else self._direct([t])[0] for t, p, found in zip(texts, plain, pieces)]


def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept for its later tasks until one of another operator keeps something."""
    return kept(path, lambda: Encoder(path))


class PartWriter:
    """Writes one part: ids as equal-length sequences, and where each document starts."""

    def __init__(self, folder: str, part: int, kind: np.dtype, attempt: int):
        self.files, root = store(folder)
        self.final = [f"{root}/part-{part:05d}.arrow", f"{root}/part-{part:05d}.docs.arrow"]
        self.temporary = [f"{root}/.{name.rpartition('/')[2]}.{attempt}" for name in self.final]
        self.kind, self.ids, self.docs = kind, pa.from_numpy_dtype(kind.newbyteorder("=")), ([], [], [])
        self.sinks = [self.files.open_output_stream(name) for name in self.temporary]
        self.schema = pa.schema([("ids", pa.list_(self.ids, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.index = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.index))]
        self.pending, self.size, self.total, self.n_docs = [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, value in zip(self.docs, (doc_id, self.total, n)):
            column.append(value)
        self.pending.append(ids)
        self.size, self.total, self.n_docs = self.size + len(ids), self.total + n, self.n_docs + 1
        if self.size >= LENGTH * BATCH * self.kind.itemsize:
            self._batches(last=False)
        if len(self.docs[0]) >= 1 << 16:
            self._index()

    def _batches(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.pending), dtype=self.kind)
        block = LENGTH * BATCH
        whole = len(values) if last else len(values) // block * block
        for k in range(0, whole, block):
            part = values[k : min(k + block, whole)]
            rows = -(-len(part) // LENGTH)
            ids = np.zeros(rows * LENGTH, dtype=self.kind)
            ids[: len(part)] = part
            mask = np.arange(rows * LENGTH) < len(part)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), LENGTH) for v in (ids, mask)]
            self.out[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.pending = [values[whole:].tobytes()]
        self.size = len(self.pending[0])

    def _index(self) -> None:
        columns = [pa.array(c, type=pa.int64()) for c in self.docs]
        self.out[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index))
        self.docs = ([], [], [])

    def close(self) -> None:
        self._batches(last=True)
        self._index()
        for out, sink, temporary, final in zip(self.out, self.sinks, self.temporary, self.final):
            out.close()
            sink.close()
            publish(self.files, temporary, final)


def write_tokens(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode ``documents`` (doc_id, text) into ``folder`` and return its manifest: part, n_docs, n_tokens, first.

    ``first`` is the number of ids in all parts before. NULL and empty texts are one end id. NULL ids come first;
    equal ids are ordered by their texts' hash. Other columns are ignored; an empty table writes an empty manifest.
    """
    path = public_tokenizers.path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, encode = TaskContext.get(), None, encoder(path)
        end = np.array([END_ID], dtype=encode.kind).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                writer = writer or PartWriter(folder, context.partitionId(), encode.kind, context.taskAttemptId())
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode.encode([t or "" for t in rows.column(1).to_pylist()])):
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": context.partitionId(), "n_docs": writer.n_docs, "n_tokens": writer.total}],
                schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    keys = ["doc_id", "tie", "row"]
    ranged = (
        documents.select(F.col("doc_id").cast("long"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())  # so that even equal rows can be dealt out
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    spark = documents.sparkSession
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    parts = f"{folder}/written"
    ranged.mapInArrow(run, "part int, n_docs long, n_tokens long").write.parquet(parts)
    listed = spark.read.schema("part int, n_docs long, n_tokens long").parquet(parts)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    listed.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(
        f"{folder}/manifest"
    )
    return spark.read.schema("part int, n_docs long, n_tokens long, first long").parquet(f"{folder}/manifest")


def read_part(folder: str, part: int, first: int) -> Iterator[pa.RecordBatch]:
    """Per document of a part: doc_id, start, n_tokens and the CRC of its ids, read batch by batch."""
    files, root = store(folder)
    name = f"{root}/part-{part:05d}"
    index = pa.ipc.open_file(files.open_input_file(f"{name}.docs.arrow")).read_all()
    at, n = index["at"].to_numpy(), index["n_tokens"].to_numpy()
    crc = np.zeros(len(at), dtype=np.int64)
    local = name if getattr(files, "type_name", "") == "local" else None
    with pa.memory_map(local + ".arrow") if local else files.open_input_file(f"{name}.arrow") as source:
        reader, doc = pa.ipc.open_file(source), 0
        block = LENGTH * BATCH
        for b in range(reader.num_record_batches):
            ids = memoryview(reader.get_batch(b).column(0).values.to_numpy(zero_copy_only=True).astype("<u4").tobytes())
            low = b * block
            high = low + len(ids) // 4
            while doc < len(at):
                begin, end = max(at[doc], low), min(at[doc] + n[doc], high)
                crc[doc] = zlib.crc32(ids[4 * (begin - low) : 4 * (end - low)], int(crc[doc]))
                if at[doc] + n[doc] > high:
                    break
                doc += 1
    for k in range(0, len(at), 1 << 16):
        rows = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [
                index["doc_id"].combine_chunks()[rows], pa.array(at[rows] + first), pa.array(n[rows]), pa.array(crc[rows]),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files of ``folder``: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read_part(folder, part, first)

    tasks = manifest.select("part", "first").repartitionByRange(4 * manifest.sparkSession.sparkContext.defaultParallelism, "part")
    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(documents: DataFrame) -> DataFrame:
    folder = new_folder(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, folder), folder)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_documents(docs)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
