"""X2 date-error matrix (a few published cells, +-1 minute) and the stream wiring."""

import pytest

from crashlens.plans.solar import date_error_matrix
from crashlens.sources import fixtures
from crashlens.streaming import harmonised_stream

from .conftest import SF001

# Published cells (minutes): (region, month) -> value; months 3 and 10 include the DST jump.
PUBLISHED = {("SH_DE", 8): 40, ("CH", 6): 10, ("BW_DE", 3): 85, ("HH_DE", 10): 93, ("BE_DE", 1): 26, ("CH", 12): 13}


def test_date_error_matrix_cells(spark):
    m = {(r.region_key, r.month): r.max_delta_min for r in date_error_matrix(spark, 2024).collect()}
    assert len(m) == 17 * 12
    for k, v in PUBLISHED.items():
        assert abs(m[k] - v) <= 1.0, (k, m[k], v)


def test_stream_harmonises_like_batch(spark, tmp_path):
    de_dir, ch_dir = tmp_path / "de", tmp_path / "ch"
    de = fixtures.raw_de(spark, SF001)
    ch = fixtures.raw_ch(spark, SF001)
    de.write.parquet(str(de_dir))
    ch.write.parquet(str(ch_dir))
    de_s = spark.readStream.schema(de.schema).parquet(str(de_dir))
    ch_s = spark.readStream.schema(ch.schema).parquet(str(ch_dir))
    q = (harmonised_stream(de_s, ch_s).writeStream.format("memory").queryName("harm_stream")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT count(*) AS n, count_if(ErrorReasons <> '') AS e FROM harm_stream").collect()[0]
    assert got.n == de.count() + ch.count() and got.e > 0
    with pytest.raises(ValueError):
        harmonised_stream(de, ch)
