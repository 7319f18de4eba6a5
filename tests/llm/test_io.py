import pyarrow as pa
import pytest

from plumbline.llm import _io, bpe

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("own", [None, "1m"])
def test_stored_tables_hand_over_small_batches(spark, own):
    """24 MB of text in one partition: Python gets it in batches of 8 MB (a row more at most), or of what the session says."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', 800) AS text")
    if own:
        spark.conf.set(LIMIT, own)
    try:
        sizes = [r["size"] for r in _io.stored(docs.mapInArrow(run, "size long"), "sizes").collect()]
        assert sum(sizes) >= 24_000_000 and max(sizes) <= (1.1 * (1 << 20) if own else 1.1 * _io.BATCH_BYTES)
        assert spark.conf.get(LIMIT, None) == own
    finally:
        spark.conf.unset(LIMIT)


def test_limit_goes_with_a_write_that_fails(spark):
    with pytest.raises(Exception, match="gone"):
        _io.stored(spark.range(1).selectExpr("raise_error('gone') AS x"), "fails")
    assert spark.conf.get(LIMIT, None) is None


def test_workers_give_back_what_they_learnt(make_docs, prose):
    path = bpe.default_path()

    def run(batches):
        seen = [0]
        for batch in batches:
            for kept in list(vars(bpe.vocabulary(path)).values()) if bpe.vocabulary.cache_info().currsize else []:
                seen.append(sum(k in kept for k in (" w17", " w23")) if isinstance(kept, dict) else 0)
            own = bpe.vocabulary(path)
            yield pa.RecordBatch.from_arrays([pa.array([max(seen)]), pa.array([len(own.pairs)])], ["words", "pairs"])

    docs = make_docs([(1, prose(1, 3000))]).coalesce(1)
    bpe.encode_and_decode(docs).collect()
    assert [tuple(r) for r in docs.mapInArrow(run, "words long, pairs long").collect()] == [(0, 0)]
