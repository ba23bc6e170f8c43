import json

from trackloom.sources import files


def test_formats(spark, tmp_path):
    def p(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    line = {"seq": "a", "frame": 3, "detections": [{"bbox": [1, 2, 3, 4], "class": "ball", "confidence": 0.5, "state": "observed"}, {"bbox": [0, 0, 9, 9], "class": "player", "confidence": 0.9}]}
    got = files.read_detections_jsonl(spark, p("d.jsonl", json.dumps(line) + "\n")).orderBy("det_ord").collect()
    assert [(r.det_ord, r.x2, r.cls, r.state) for r in got] == [(0, 3.0, "ball", "observed"), (1, 9.0, "player", None)]

    tracks = spark.createDataFrame([("s", 0, 7, 1.0, 2.0, 4.5, 6.25), ("s", 1, 7, 1.0, 2.0, 4.5, 6.25), ("t", 0, 1, 0.0, 0.0, 1.0, 1.0)], "seq string, frame int, track_id long, x1 double, y1 double, x2 double, y2 double")
    files.write_mot(tracks, str(tmp_path / "mot"))
    back = files.read_mot(spark, str(tmp_path / "mot" / "*")).select(*tracks.columns)
    assert sorted(back.collect()) == sorted(tracks.collect())

    p("y/img1.txt", "0 0.5 0.5 0.2 0.4\n1 0.1 0.1 0.3 0.1 0.3 0.5\n2 x 0.5 0.1 0.1\n3 0.5\n")
    got = {r.cls_id: r for r in files.read_yolo_labels(spark, str(tmp_path / "y")).collect()}
    assert (got[0].image, got[0].w, got[0].polygon, got[0].problem) == ("img1", 0.2, False, None)
    assert (round(got[1].cx, 9), round(got[1].h, 9), got[1].polygon) == (0.2, 0.4, True) and got[2].problem == got[3].problem == "malformed"

    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 5}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 4, "bbox": [1, 1, 2, 3]}], "categories": [{"id": 4, "name": "ball"}]}
    got = {r.file_name: r for r in files.read_coco(spark, p("c.json", json.dumps(coco, indent=1))).collect()}
    assert (got["a.jpg"].cls, got["a.jpg"].y2, got["b.jpg"].ann_id) == ("ball", 4.0, None)

    xml = '<annotations><track id="3" label="player"><box frame="0" xtl="1" ytl="2" xbr="3" ybr="4" outside="0" occluded="1"/><box frame="5" xtl="2" ytl="2" xbr="4" ybr="4" outside="1" occluded="0"/></track></annotations>'
    got = files.read_cvat_tracks(spark, p("t.xml", xml)).orderBy("frame").collect()
    assert [(r.track_id, r.cls, r.frame, r.x2, r.outside, r.occluded) for r in got] == [(3, "player", 0, 3.0, False, True), (3, "player", 5, 4.0, True, False)]

    got = files.read_decisions(spark, p("l.jsonl", '{"line_no": 1, "box_id": "b", "value": "v"}\n')).collect()
    assert got[0].mode == "candidates"


def test_materialize_reuses_only_equal_settings(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    path = str(tmp_path / "m")
    assert files.materialize(one, path, {"a": 1, "b": 2}).count() == 3
    assert files.materialize(two, path, {"b": 2, "a": 1}).count() == 3
    assert files.materialize(two, path, {"b": 3, "a": 1}).count() == 5


def test_scan_and_manifest(spark):
    df = spark.createDataFrame([("s", i, {"k": "v", "z": None if i % 2 else "w"}) for i in range(5)], "seq string, i int, m map<string,string>")
    some, census = files.scan_annotations(df, 2, ["seq", "i"], "m")
    assert sorted(r.i for r in some.collect()) == [0, 2, 4]
    assert {r.key: (r.rows, r["values"]) for r in census.collect()} == {"k": (5, 5), "z": (5, 3)}
    shares = files.manifest(spark.createDataFrame([("a",), ("a",), ("b",), ("a",)], "source string"))
    assert {r.source: r.share for r in shares.collect()} == {"a": 0.75, "b": 0.25}
