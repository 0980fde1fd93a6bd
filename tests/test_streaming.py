"""The streaming finish-reason counts equal the batch operator on the same responses."""

import tempfile

from colsense.operators import parse
from colsense.sources import fixtures as fx
from colsense.streaming import finish_reason_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    folder = tempfile.mkdtemp(prefix="colsense-stream-")
    resp = fx.responses(spark, SF)
    resp.write.mode("overwrite").parquet(folder + "/in")
    q = (finish_reason_stream(spark, folder + "/in").writeStream.outputMode("complete")
         .format("memory").queryName("finish_reasons_stream")
         .option("checkpointLocation", folder + "/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {r["finish_reason"]: r["n"] for r in spark.sql("SELECT * FROM finish_reasons_stream").collect()}
    want = {r["finish_reason"]: r["n"] for r in parse.finish_reason_counts(parse.parse_predictions(resp)).collect()}
    assert got == want
