"""The file stream lands what the batch reader reads."""

from tracemill.functions.tables import INDEX_FIELDS
from tracemill.sources import index as ix
from tracemill.streaming.ingest import land_index, stream_index


def test_stream_equals_batch(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    line = lambda no: "|".join([str(no), "1.5", "eth:ip:udp:dns", "1.1.1.1", "2.2.2.2"] + [""] * (len(INDEX_FIELDS) - 5))
    for round_no in (1, 2):
        (tmp_path / "in" / f"cap{round_no}.txt").write_text("\n".join([line(1), "bad", "", line(2)]) + "\n")
        query = land_index(stream_index(spark, source), target, check, available_now=True)
        query.awaitTermination(60)
        landed = spark.read.parquet(target)
        good, bad = ix.read_index(spark, source)
        assert landed.where("is_valid = 'true'").count() == good.count() == 2 * round_no
        assert landed.where("is_valid = 'false'").count() == bad.count() == round_no
    keys = lambda df: sorted((r.capture_id, r.frame_no, r.src_ip) for r in df.select("capture_id", "frame_no", "src_ip").collect())
    assert keys(spark.read.parquet(target).where("is_valid = 'true'")) == keys(good)
