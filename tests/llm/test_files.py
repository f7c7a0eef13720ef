"""Token files, WARC archives and shards."""

import gzip
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from usagelens.llm import sharding, tokens, warc
from usagelens.llm.shared import new_folder, store

AWKWARD = ["", " ", "it's we'll\n\n  x", "<|endoftext|> end", "日本 text ñandú", "tab\t\ttab  nbsp", "12 34,5 ¼²", "a" * 30_000, "!?! ... '' 's'S", "ends in blanks   ", "\r\n\x0b\x1c", "Ǆ ʻ ə", "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_pieces_give_the_ids_of_the_whole_text(library, monkeypatch):
    texts = AWKWARD + [t or "" for t in pd.read_parquet(f"{SMALL}/documents.parquet").text]
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    for cache in (1_000_000, 50):
        monkeypatch.setattr(tokens, "CACHE", cache)
        got = [x for k in range(0, len(texts), 7) for x in encoder.encode(texts[k : k + 7])]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def expected(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query(spark, library):
    table = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    got = tokens.op4_tokens(spark, SMALL).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(library, zip(table.doc_id, table.text))


def test_token_edge_cases_and_layout(spark, docs, library, monkeypatch):
    rows = [(None, "null id"), *((i, t) for i, t in enumerate(AWKWARD)), (90, None), (91, "same"), (91, "same")]
    folder = new_folder(spark, "tokens-test")
    manifest = tokens.write_tokens(docs(*rows), folder)
    got = [tuple(r) for r in tokens.read_tokens(manifest, folder).orderBy("start").collect()]
    assert got == expected(library, rows)
    files, root = store(folder)
    sizes = 0
    for part in manifest.collect():
        with pa.memory_map(f"{root}/part-{part.part:05d}.arrow") as source:
            whole = pa.ipc.open_file(source).read_all()
        assert whole["ids"].type == pa.list_(pa.uint16(), tokens.LENGTH)
        ids, mask = (np.concatenate([c.values.to_numpy(zero_copy_only=False) for c in whole[n].chunks]) for n in ("ids", "mask"))
        assert mask.sum() == part.n_tokens and mask[: part.n_tokens].all() and not ids[part.n_tokens :].any()
        sizes += part.n_tokens
    assert sizes == sum(n for _, _, n, _ in got)
    assert tokens.encode_documents(docs(*rows).limit(0)).count() == 0


def test_archives_edge_cases(spark):
    long = "é" * 60
    rows = [(7, "http://a/ b\r\nX: y", long), (3, None, long), (3, None, long), (9, "u", None), (8, "u", ""), (5, "u", "short"), (4, "u", "short"), (None, "u", long), (11, "u", "z" * 300_000), (12, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS first", "3 AS digest")
    folder = new_folder(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, limit=400)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect()), key=str)
    want = [(7, 120, "revisit", 3), (3, 120, "response", None), (3, 120, "response", None), (9, 0, "response", None), (8, 0, "response", None), (5, 5, "response", None), (4, 5, "response", None), (0, 120, "revisit", 3), (11, 300_000, "response", None), (12, 300_000, "revisit", 11)]
    assert got == sorted(want, key=str)
    listed = manifest.collect()
    assert len(listed) > 2 and sum(r.n_records for r in listed) == len(rows)
    files, root = store(folder)
    for row in listed:
        raw = open(f"{root}/{row.file}", "rb").read()
        assert len(raw) == row.n_bytes and gzip.decompress(raw).startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in gzip.decompress(raw)
    empty = new_folder(spark, "warc-test")
    assert warc.read_archives(warc.write_archives(pages.limit(0), empty), empty).count() == 0


def test_equal_input_gives_equal_archives(spark):
    from usagelens.llm.shared import table

    found = []
    for _ in range(2):
        folder = new_folder(spark, "warc-test")
        manifest = warc.write_archives(table(spark, SMALL, "pages"), folder)
        _, root = store(folder)
        found.append([(r.file, open(f"{root}/{r.file}", "rb").read()) for r in manifest.orderBy("file").collect()])
    assert found[0] == found[1]


def test_shards_of_the_table(spark):
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = sharding.op2_sharding(spark, SMALL).toPandas().merge(table[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(table)
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in got.text]
    assert got.text_crc32.tolist() == [zlib.crc32((t or "").encode()) for t in got.text]
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_shards_balance_with_a_hot_text(spark):
    frame = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot text ', 20) ELSE repeat(concat('w', id, ' '), cast(5 + id % 40 AS int)) END AS text")
    got = sharding.pack(frame).toPandas().merge(frame.toPandas(), on="doc_id")
    per = got.groupby("shard").agg(size=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "count"))
    assert len(per) == 16
    for c in per:
        assert per[c].max() < 1.02 * per[c].mean() and per[c].min() > 0.98 * per[c].mean()
    spread = got.groupby("text").shard.nunique()
    assert spread.drop("hot text " * 20).max() == 1 and spread["hot text " * 20] > 1


def test_shards_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "long " * 50_000)]
    got = sharding.pack(docs(*rows))
    assert sorted((str(r.doc_id), r.size) for r in got.collect()) == [("1", 1), ("2", 1), ("2", 1), ("3", 250_001), ("None", 2)]
    empty = sharding.pack(docs(*rows).limit(0))
    assert empty.schema.names == got.schema.names and empty.count() == 0
