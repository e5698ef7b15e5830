from forewarn.streaming.ingest import check_rows, write_checked
from tests.fixtures import SPEC, telemetry


def test_stream_and_batch_apply_the_same_rules(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = telemetry(spark, range(40), {3: {"TP2": 77.0}, 9: {"timestamp": None}, 12: {"COMP": 0.5}})
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    paths = [str(tmp_path / n) for n in ("ok", "bad", "state")]
    for query in write_checked(check_rows(stream, SPEC), *paths):
        query.awaitTermination(60)
    assert spark.read.parquet(paths[0]).count() == 37
    rejected = {r["row_order"]: r["reasons"] for r in spark.read.parquet(paths[1]).collect()}
    assert rejected == {3: ["TP2_out_of_range"], 9: ["timestamp_missing"], 12: ["COMP_not_binary"]}
