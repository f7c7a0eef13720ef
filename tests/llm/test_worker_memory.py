"""What a Python worker holds: Arrow batches limited in bytes, and one remembered thing per process."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usagelens.llm import shared, simhash, tokens, toxicity


@pytest.fixture
def own_session(spark):
    """The session with its batch setting put back afterwards."""
    before = spark.conf.getAll.get(shared.ARROW_BYTES)
    spark.conf.unset(shared.ARROW_BYTES)
    yield spark
    spark.conf.unset(shared.ARROW_BYTES) if before is None else spark.conf.set(shared.ARROW_BYTES, before)


def _largest_batch(frame):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    return frame.mapInArrow(run, "n long, size long").agg(F.max("size"), F.sum("n")).first()


def test_near_dedup_stage_gets_batches_of_bounded_bytes(own_session, docs):
    simhash.stage(own_session, docs((1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")), "")
    texts = own_session.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))  # 20 MB in one task
    size, rows = _largest_batch(texts)
    assert rows == 4000 and size < 2 * shared.BATCH_BYTES


def test_a_limit_of_the_session_stays(own_session):
    own_session.conf.set(shared.ARROW_BYTES, "1000000")
    shared.small_batches(own_session)
    assert own_session.conf.get(shared.ARROW_BYTES).rstrip("b") == "1000000"


def test_a_worker_keeps_one_thing(monkeypatch):
    monkeypatch.setattr(tokens, "Encoder", lambda path: [path])
    encoder = tokens.encoder("a")
    assert tokens.encoder("a") is encoder
    space = toxicity.Space({"word": 0}, toxicity.np.ones(1))
    space.vector("word word")
    assert shared._kept[0] is space and "word" in shared._kept[1]  # the encoder is gone
    space.vector("another word")
    assert set(shared._kept[1]) == {"word", "another"}
    toxicity.Space({"word": 0}, toxicity.np.ones(1)).vector("new")
    assert set(shared._kept[1]) == {"new"}
    assert tokens.encoder("a") is not encoder
    shared.release()
    assert shared._kept == [None, None]
