"""The stateless label step runs on a streaming DataFrame."""

from scorewise.sources.tables import CREDIT_SCHEMA
from scorewise.streaming.prepare import credit_stream


def test_credit_stream_labels(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, -1, "X"), (1, -2, "3"), (2, -1, "7")]
    spark.createDataFrame(rows, CREDIT_SCHEMA).write.parquet(str(src))
    q = credit_stream(spark, str(src)).writeStream.format("memory").queryName("labelled").start()
    try:
        q.processAllAvailable()
        got = sorted(
            ((r["MONTHS_BALANCE"], r["response"]) for r in spark.table("labelled").collect()),
            key=lambda t: (t[0], t[1] is not None, t[1] or 0.0),
        )
    finally:
        q.stop()
    assert got == [(-2, 0.0), (-1, None), (-1, 1.0)]
