"""Target-distribution importance resampling over hashed n-grams.

Every text is folded to lower case (A-Z only), its separators are collapsed to single spaces, and one regular expression
per n-gram length scans it with overlapping matches: look-arounds at the word boundaries make each match an n-gram that
starts at a word, so the match's bytes go to the CRC as they are. Features are the buckets of these CRCs.

``features`` stores each document's distinct buckets and counts once, as little-endian arrays. Bucket totals of all
documents and of all target texts are sums of one dense vector per task. A bucket's gain is its log ratio; a document's
weight is the sum of its gains, and a Gumbel number drawn from its id makes the highest scores a sample without
replacement. Only the vector of ``BUCKETS`` gains is collected and broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.ranking import global_rank
from usagelens.llm.shared import stored, table

BUCKETS = 10_000
NGRAMS = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10

_WORD = [48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))
_SPACES = re.compile(rb"  +")


def scanners(ngrams: int) -> list[regex.Pattern]:
    """One pattern per length: words joined by one space, a boundary on either side."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, ngrams + 1)]


def folded(raw: bytes) -> bytes:
    return _SPACES.sub(b" ", raw.translate(_FOLD))


def buckets(raw: bytes, found: list[regex.Pattern]) -> tuple[np.ndarray, int]:
    """The buckets of all n-grams of a UTF-8 text, in order of length and place, and how many are single words."""
    text, crc, out = folded(raw), zlib.crc32, []
    for k, scanner in enumerate(found):
        out.append(np.array([crc(m[0]) for m in scanner.finditer(text, overlapped=True)], dtype=np.int64) % BUCKETS)
        if not k:
            words = len(out[0])
    return np.concatenate(out), words


def features(texts: DataFrame, ngrams: int = NGRAMS) -> DataFrame:
    """``texts`` (id, text) as rows (id, n_words, n_features, buckets, counts): distinct buckets, rising, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanners(ngrams)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, words = buckets(text.as_py() or b"", scan)
                distinct, counts = np.unique(found, return_counts=True)
                out.append((key, words, len(found), distinct.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(columns, kinds)],
                names=["id", "n_words", "n_features", "buckets", "counts"],
            )

    narrow = texts.select(F.col("id").cast("long"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, "id long, n_words long, n_features long, buckets binary, counts binary")


def totals(found: DataFrame) -> DataFrame:
    """Rows (bucket, n): how often each bucket that occurs is met in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            where = [np.frombuffer(b"".join(c.to_pylist()), dtype=t) for c, t in zip(batch.columns, ("<u2", "<u4"))]
            total += np.bincount(where[0], weights=where[1], minlength=BUCKETS).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return found.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (bucket, gain) for all ``BUCKETS``: the log ratio of target to source with add-one smoothing, in thousandths."""
    spark = source.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    of = lambda frame: frame.select(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (of(source) + BUCKETS) / ((s + 1) * (of(target) + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` rows with ``weight``, the sum of the gains of all features; no features weigh 0."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            raw = batch.column(3).to_pylist()
            where, n = np.frombuffer(b"".join(raw), dtype="<u2"), np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u4")
            running = np.concatenate([[0], np.cumsum(gain[where] * n)])
            ends = np.cumsum([len(r) // 2 for r in raw], dtype=np.int64)
            weight = np.diff(running[np.concatenate([[0], ends]).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, type=pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, ngrams: int = NGRAMS) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_features, weight, score, rank.

    ``target`` needs a column ``text``. ``percent`` of the documents with at least ``MIN_WORDS`` words are drawn; rank is
    NULL for all others. NULL and empty texts have no features and weight 0. Ties go to the smaller id, NULL ids first
    (their Gumbel number is drawn from the empty string), then to fewer features; equal rows are ranked one after the
    other. Other columns are ignored. An empty table gives no rows, an empty target gains from smoothing alone.
    """
    spark = documents.sparkSession
    found = stored(features(documents.select(F.col("doc_id").alias("id"), "text"), ngrams), "features")
    wanted = stored(totals(features(target.select(F.lit(None).cast("long").alias("id"), "text"), ngrams)), "target")
    listed = gains(stored(totals(found), "source"), wanted).toArrow()  # BUCKETS rows
    gain = np.zeros(BUCKETS, dtype=np.int64)
    gain[listed["bucket"].to_numpy()] = listed["gain"].to_numpy()
    seed = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weighted(found, gain).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= MIN_WORDS)
    order = [F.desc("score"), F.asc_nulls_first("id"), "n_features", "weight"]
    ranked = global_rank(able, order).withColumn("rank", F.when(F.col("_rank") <= F.expr(f"_n * {int(percent)} div 100"), F.col("_rank")))
    rest = scored.where(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*columns).unionAll(rest.select(*columns))


def drawn(documents: DataFrame, target: DataFrame, percent: int = PERCENT, ngrams: int = NGRAMS) -> DataFrame:
    """The rows of ``documents`` that are drawn, all columns kept; ids must be unique and not NULL."""
    chosen = resample(documents, target, percent, ngrams).where("rank IS NOT NULL").select("doc_id")
    return documents.join(chosen, "doc_id", "left_semi").select(*documents.columns)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS entries
  FROM range(0, 256) r(i)
), words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)
), vocabulary AS (SELECT DISTINCT word FROM words), bytes AS (
  SELECT word, list_transform(range(0, strlen(word)), lambda k: ('0x' || substr(hex(word), 2 * k + 1, 2))::BIGINT) AS b FROM vocabulary
), hashed AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table
), counted AS (
  SELECT doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (doc_id >= 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (doc_id < 0), 0)::DOUBLE AS t
  FROM counted GROUP BY ALL
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain
  FROM sums
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket)
  WHERE doc_id >= 0 GROUP BY ALL
), scores AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""
