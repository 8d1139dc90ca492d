"""Label files are parsed once."""

from __future__ import annotations

from posegrid.operators.detections import parse_frame_labels


def test_parsed_once(spark):
    one = '{"labels": {"7": {"instance_id": 7, "class_name": "person", "x1": 1, "y1": 2, "x2": 3, "y2": 4, "score": 0.5}}}'
    df = spark.createDataFrame([("a/mask_000004.json", one), ("a/mask_000005.json", '{"labels": {}}'), ("a/mask_000006.json", None), ("a/mask_000007.json", "no json")], "path string, json string")
    out = parse_frame_labels(df)
    assert [(x.frame_idx, x.ord, x.person_id, x.x2) for x in out.collect()] == [(4, 0, 7, 3.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
