from __future__ import annotations

from sieveline.plans.analysis_queries import s2_scan_filters


def test_bundles_by_the_thresholds_of_the_scan(spark, tmp_path):
    texts = ["x" * 3_000, ("x" * 300 + "\n") * 100, ("x" * 500 + "\n") * 50, "x\n" * 20_000]
    rows = [(i, "p", f"src/{i}.js", text) for i, text in enumerate(texts)]
    files = spark.createDataFrame(rows, "file_id bigint, project string, relative string, text string")
    files.write.parquet(str(tmp_path / "indexed_file.parquet"))
    found = {r.file_id: r.is_bundle for r in s2_scan_filters(spark, str(tmp_path)).collect()}
    assert found == {0: False, 1: False, 2: True, 3: False}
