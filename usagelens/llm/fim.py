"""Fill-in-middle transformation by secondary-sort assembly.

A text of n units (a run of ASCII letters, or any other single character) is cut into prefix, middle and suffix at two
positions drawn from the document's id, and its output puts them in another order between the markers ``<P>``, ``<S>``
and ``<M>``.

No text is put together in memory. Every document is emitted as pieces, the markers and chunks of at most ``CHUNK``
units, keyed by the row and the piece's position in the output. ``repartition`` by the row with
``sortWithinPartitions`` (one exchange: the DataFrame form of repartitionAndSortWithinPartitions) delivers them in
output order, and a digest is fed piece by piece. The same stream is then read as an output: the markers met in it tell
prefix, suffix and middle apart, which gives each piece its position in the original, and a second sort within the
partition (no exchange) delivers the restored text to a second digest. A row is the unit of skew: a long document is many
small pieces, copies are different rows, and sorts spill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import table

CHUNK = 8192
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
SALT = "1:"
MARKERS = {"P": "<P>", "S": "<S>", "M": "<M>"}
ORDER = {"psm": "PSM", "spm": "SPM"}
#: Positions are section * SECTION + index; a section is at most 2^31 characters long.
SECTION = 1 << 32
LAST = 4 * SECTION
PIECES = "row long, at long, kind string, content string, doc_id long, n long, form string, prefix_chars long, middle_chars long"
ROWS = 256


def unit_starts(text: str) -> np.ndarray:
    """Code-point positions at which the units of a text start."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points | 32) - 97 < 26) & (points < 128)  # unsigned: below "a" wraps around
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    return np.flatnonzero(~inner)


def plan(doc_id: int | None, text: str, n: int) -> tuple[str, int, int]:
    """Form of a document and the units after which its prefix and its middle end."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKERS.values()) or h3 % 100 >= PLAIN_FROM:
        return "plain", a, b
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def _chunks(text: str, starts: np.ndarray, first: int, last: int) -> Iterator[str]:
    """The units ``first`` to ``last`` of a text in chunks."""
    for k in range(first, last, CHUNK):
        end = min(k + CHUNK, last)
        yield text[starts[k] : starts[end] if end < len(starts) else None]


def pieces(documents: DataFrame) -> DataFrame:
    """The outputs as pieces: row, at, kind, content and, on the last piece of a row, what is known of the document.

    ``at`` orders the pieces of a row; kind ``t`` holds text, ``m`` a marker, ``e`` ends the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                out = []
                for row, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)):
                    text = text or ""
                    starts = unit_starts(text)
                    n = len(starts)
                    form, a, b = plan(doc_id, text, n)
                    at = [0, a, b, n]
                    sections = {"P": (0, a), "M": (a, b), "S": (b, n)} if form != "plain" else {"": (0, n)}
                    for s, name in enumerate(ORDER.get(form, [""])):
                        if name:
                            out.append((row, s * SECTION, "m", MARKERS[name]))
                        out += [(row, s * SECTION + 1 + i, "t", c) for i, c in enumerate(_chunks(text, starts, *sections[name]))]
                    edge = [int(starts[x]) if x < n else len(text) for x in at]
                    chars = (None, None) if form == "plain" else (edge[1], edge[2] - edge[1])
                    out.append((row, LAST, "e", None, doc_id, n, form, *chars))
                yield _batch(out)

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(run, PIECES)


_ARROW = pa.schema(
    [("row", pa.int64()), ("at", pa.int64()), ("kind", pa.string()), ("content", pa.string()), ("doc_id", pa.int64())]
    + [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*(r + (None,) * (len(_ARROW) - len(r)) for r in rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def in_order(found: DataFrame) -> DataFrame:
    """Pieces dealt out by row and sorted by position: the outputs, streamed."""
    return found.repartition("row").sortWithinPartitions("row", "at")


def _original_place(section: str, met: dict[str, int]) -> int:
    """Position in the original text of the next piece of a section of the output."""
    met[section] = met.get(section, 0) + 1
    return "PMS".index(section) * SECTION + met[section] if section else met[section]


def digests(ordered: DataFrame) -> DataFrame:
    """One row per document from pieces in output order: its plan, the output's digest and the restored text's digest."""

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Feeds each output to its digest; gives its pieces their places in the original and drops the markers."""
        digest, section, met = hashlib.sha256(), "", {}
        names = {m: k for k, m in MARKERS.items()}
        for batch in batches:
            out = []
            for row, at, kind, content, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "e":
                    out.append((row, LAST, kind, digest.hexdigest(), *rest))
                    digest, section, met = hashlib.sha256(), "", {}
                    continue
                digest.update(content.encode())
                # a text with a marker in it stays plain, so a marker's text is always a marker in the other forms
                if kind == "m":
                    section = names[content]
                else:
                    out.append((row, _original_place(section, met), kind, content))
            yield _batch(out)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            for _, _, kind, content, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "e":
                    out.append((*rest, content, digest.hexdigest()))
                    digest = hashlib.sha256()
                else:
                    digest.update(content.encode())
            fields = [*list(_ARROW)[4:], pa.field("output_sha256", pa.string()), pa.field("restored_sha256", pa.string())]
            columns = zip(*out) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

    resorted = ordered.mapInArrow(outputs, PIECES).sortWithinPartitions("row", "at")
    return resorted.mapInArrow(
        restored,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


def transform(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    NULL and empty texts are plain with n = 0. A NULL id draws from the empty string. Repeated rows give repeated rows.
    Texts of any length are streamed in chunks. Other columns are ignored; an empty table gives no rows.
    """
    return digests(in_order(pieces(documents)))


def outputs(documents: DataFrame) -> DataFrame:
    """The output texts: doc_id, form, output. An output is as long as its document, and held once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            out = []
            for _, _, kind, content, doc_id, _, form, *_ in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "e":
                    out.append((doc_id, form, "".join(held)))
                    held = []
                else:
                    held.append(content)
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=["doc_id", "form", "output"])

    return in_order(pieces(documents)).mapInArrow(run, "doc_id long, form string, output string")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || doc_id::VARCHAR) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::UBIGINT) AS d FROM cut
), placed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS a, greatest(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90
              THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""
