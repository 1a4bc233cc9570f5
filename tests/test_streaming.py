from __future__ import annotations

import json

from fieldloom.streaming.arrivals import keep_pending, stream_listing


def test_arrivals_are_recorded_once(spark, tmp_path):
    spark.createDataFrame([("20240116", 5), ("20240331", 0)], "date8 string, length long").write.parquet(f"{tmp_path}/processed")
    (tmp_path / "in").mkdir()

    def arrive(name, *dates):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"path": f"/s2/S2H_2024_{d}.tif", "length": 9}) + "\n" for d in dates))
        keep_pending(stream_listing(spark, f"{tmp_path}/in"), f"{tmp_path}/processed", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    arrive("a.json", "2024_01_16", "2024_03_31", "2024_05_15")
    arrive("b.json", "2024_05_15", "2024_06_29")
    assert sorted(r.date8 for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["20240331", "20240515", "20240629"]
