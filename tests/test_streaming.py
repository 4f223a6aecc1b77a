from datetime import datetime

from tapeworks.streaming.bars import bars_from_ticks

SCHEMA = "symbol string, ts timestamp, price double, size double, seq long"


def test_bars_of_a_stream_equal_bars_of_the_table(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 2, h, m)
    first = [("A", at(9, 5), 1.0, 2.0, 1), ("A", at(9, 5), 3.0, None, 2), ("A", at(9, 50), 2.0, 1.0, 3), ("B", at(9, 1), 5.0, 1.0, 1), ("A", None, 9.0, 1.0, 4), ("A", at(10, 0), None, 1.0, 5)]
    second = [("A", at(14, 0), 4.0, 1.0, 6), ("B", at(10, 30), 7.0, 1.0, 2)]
    third = [("B", at(14, 1), 8.0, 1.0, 4)]  # the watermark of a batch bars late ticks from the batch after the next
    late = [("B", at(9, 30), 99.0, 1.0, 3), ("A", at(20, 0), 6.0, 1.0, 7)]
    for k, rows in enumerate((first, second, third, late)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = bars_from_ticks(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append")
    out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = {(r["symbol"], r["ts"].hour): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {("A", 9): (1.0, 3.0, 1.0, 2.0, 3.0), ("B", 9): (5.0, 5.0, 5.0, 5.0, 1.0), ("B", 10): (7.0, 7.0, 7.0, 7.0, 1.0), ("A", 14): (4.0, 4.0, 4.0, 4.0, 1.0), ("B", 14): (8.0, 8.0, 8.0, 8.0, 1.0)}
    assert got == want  # the late tick of B is left out; the last window of A is still open
    table = {(r["symbol"], r["ts"].hour): tuple(r)[2:] for r in bars_from_ticks(spark.createDataFrame(first + second + third, SCHEMA)).collect()}
    assert table == want
