"""The behaviours end to end, from case folders to documents."""

import json

import numpy as np
import pytest

from gridloom.config import Config, InvalidResolutionError, MapError, load
from gridloom.plans import requests as plans
from gridloom.sources import maps as source


@pytest.fixture(scope="module")
def cases(tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    for name, labelled in (("plain", False), ("labelled", True)):
        folder = root / name
        folder.mkdir()
        img = np.zeros((60, 100), np.uint8)
        img[2:58, 2:48] = img[2:58, 52:98] = 254
        (folder / "saved_map.png").write_bytes(source.encode_png(img))
        (folder / "saved_map.json").write_text(json.dumps({"resolution": 0.05, "origin": [0.0, 0.0]}))
        (folder / "mapinfo.json").write_text(json.dumps({"robot_model": "S-K20PRO", "uuid": 'u-"test"'}))
        (folder / "markers.json").write_text(json.dumps({"data": [{"name": "CHARGE", "type": "pose", "geometry": [0.5, 0.5, 0.0]}]}))
        if labelled:
            room = lambda i, n, x0, x1: {"name": n, "id": i, "type": "polygon", "geometry": [x0, 0.2, x0, 2.8, x1, 2.8, x1, 0.2, x0, 0.2], "colorType": 1, "graph": [], "groundMaterial": None}
            (folder / "labels.json").write_text(json.dumps({"version": "v", "uuid": "u-test", "data": [room("ROOM_001", "A", 0.2, 1.2), room("ROOM_007", "C", 1.2, 2.2), room("ROOM_003", "D", 3.0, 4.6)]}))
    (root / "broken").mkdir()
    (root / "broken" / "saved_map.png").write_bytes(b"\x89PNG\r\n\x1a\nno image")
    (root / "broken" / "saved_map.json").write_text(json.dumps({"resolution": 0.05, "origin": [0.0, 0.0]}))
    return str(root)


def test_all_behaviours(spark, cases):
    maps = source.read_maps(spark, cases).cache()
    rows = [
        ("1", "plain", "split", None, None),
        ("2", "labelled", "repartition", None, None),
        ("3", "labelled", "division", None, ("ROOM_001", [-1.0, 1.5], [5.0, 1.5])),
        ("4", "labelled", "merge", ["ROOM_001", "ROOM_007"], None),
        ("5", "labelled", "merge", ["ROOM_001", "ROOM_003"], None),
        ("6", "plain", "merge", ["ROOM_001", "ROOM_003"], None),
        ("7", "labelled", "division", None, ("ROOM_009", [0.0, 0.0], [1.0, 1.0])),
        ("8", "labelled", "division", None, ("ROOM_001", [9.0, 9.0], [10.0, 9.0])),
        ("9", "labelled", "dance", None, None),
        ("10", "labelled", "merge", ["ROOM_001"], None),
        ("11", "labelled", "split", None, None),
        ("13", "labelled", "merge", None, None),
        ("14", "nowhere", "division", None, None),
        ("1x", "broken", "split", None, None),
        ("12", "labelled", "division", None, ("ROOM_001", [-1.0, 0.25], [5.0, 0.25])),
    ]
    requests = spark.createDataFrame(rows, "request_id string, map_id string, operation string, room_merge_list array<string>, division struct<id:string,A:array<double>,B:array<double>>")
    got = {r.request_id: (r.statusCode, r.body) for r in plans.run(requests, maps).collect()}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v[0] == 190} == {"5": (190, "8"), "6": (190, "3"), "7": (190, "7"), "8": (190, "5"), "1x": (190, "1"), "10": (190, "4"), "12": (190, "10")}
    assert got["9"] == (171, "no such operation") and got["13"] == (171, "need room merge list") and got["14"] == (171, "need division croods list")
    for k in ("1", "2"):
        body = json.loads(got[k][1])
        rooms = [i for i in body["data"] if "ROOM" in i["id"] and "LANDMARK" not in i["id"]]
        assert [r["id"] for r in rooms] == ["ROOM_001", "ROOM_002"] and [r["name"] for r in rooms] == ["A", "B"]
        assert len(body["data"]) == 4 and body["uuid"] == 'u-"test"' and body["data"][2]["roomId"] == "ROOM_001"
        assert rooms[0]["geometry"][:2] == rooms[0]["geometry"][-2:]
    parts = [i for i in json.loads(got["3"][1])["data"] if i["type"] == "polygon"]
    assert [p["id"] for p in parts] == ["ROOM_001", "ROOM_007", "ROOM_003", "ROOM_008"] and parts[3]["name"] == "B"
    assert 3 in parts[0]["graph"] and parts[0]["colorType"] != parts[3]["colorType"]
    merged = [i for i in json.loads(got["4"][1])["data"] if i["type"] == "polygon"]
    assert [p["id"] for p in merged] == ["ROOM_001", "ROOM_003"]
    xy = np.array(merged[0]["geometry"]).reshape(-1, 2)[:-1]
    assert abs(abs((xy[:, 0] * np.roll(xy[:, 1], -1) - np.roll(xy[:, 0], -1) * xy[:, 1]).sum() / 2) - 2.0 * 2.6) < 1e-6
    wider = [i for i in json.loads(got["11"][1])["data"] if i["type"] == "polygon"]
    assert [p["id"] for p in wider][:3] == ["ROOM_001", "ROOM_007", "ROOM_003"]


def test_requests_from_files(spark, cases, tmp_path):
    """As the README shows it: request lines in, answers out. Rooms that an edit leaves alone keep their landmarks."""
    mark = {"geometry": [3.3, 2.2, 0.0], "id": "PLATFORM_LANDMARK_009", "roomId": "ROOM_003", "name": "old", "type": "pose"}
    document = json.load(open(f"{cases}/labelled/labels.json"))
    full = dict(document, data=document["data"] + [mark])
    last = dict(document, data=[*document["data"][:2], dict(document["data"][2], id="ROOM_999")])
    for name, labels in (("marked", full), ("last", last)):
        (tmp_path / "cases" / name).mkdir(parents=True)
        for file in ("saved_map.png", "saved_map.json", "mapinfo.json", "markers.json"):
            (tmp_path / "cases" / name / file).write_bytes(open(f"{cases}/labelled/{file}", "rb").read())
        (tmp_path / "cases" / name / "labels.json").write_text(json.dumps(labels))
    cut = {"id": "ROOM_001", "A": [-1.0, 1.5], "B": [5.0, 1.5]}
    lines = [
        {"request_id": "m", "operation": "merge", "bucket": "b", "key": "x/marked/", "roomMergeList": ["ROOM_001", "ROOM_007"]},
        {"request_id": "d", "operation": "division", "bucket": "b", "key": "x/last", "divisionCroodsDict": cut},
        {"operation": "dance", "bucket": "b", "key": "x/marked"},
        {"operation": "split", "bucket": "b", "key": "x/nowhere"},
    ]
    (tmp_path / "requests.json").write_text("\n".join(map(json.dumps, lines)))
    maps = source.read_maps(spark, str(tmp_path / "cases"))
    got = {r.request_id: (r.statusCode, r.body) for r in plans.run(source.read_requests(spark, str(tmp_path / "requests.json")), maps).collect()}
    assert len(got) == 4 and got["d"] == (190, "0")
    assert sorted(v for k, v in got.items() if k not in "md") == [(171, "no such operation"), (190, "11")]
    marks = [i for i in json.loads(got["m"][1])["data"] if i["type"] == "pose"]
    assert [(m["roomId"], m["id"]) for m in marks] == [("ROOM_001", "PLATFORM_LANDMARK_001"), ("ROOM_003", "PLATFORM_LANDMARK_002")]
    assert marks[1]["geometry"] == [3.3, 2.2, 0.0] and marks[1]["name"] == "D"


def test_config_and_errors():
    assert load(environ={}).labels_version == "v4.0.2_0.0.1"
    got = load({"resolution": 0.1}, {"min_room_area": 2}, {"TARGET_SIZE": "640,480", "RESOLUTION": "0.2"})
    assert got.target_size == (640, 480) and got.resolution == 0.2 and got.min_room_area == 2.0
    assert InvalidResolutionError("x").code == 2 and issubclass(InvalidResolutionError, MapError)
    assert Config().nms_threshold == 0.35


def test_answers_to_files_and_streams(spark, cases, tmp_path):
    """Labels documents as files by map; requests that arrive as files are answered batch by batch."""
    from gridloom.streaming.requests import SCHEMA, serve

    maps = source.read_maps(spark, cases).where("map_id != 'broken'").cache()
    inbox, outbox = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "one.json").write_text(json.dumps({"request_id": "a", "map_id": "labelled", "operation": "merge", "room_merge_list": ["ROOM_001", "ROOM_007"]}) + "\n" + json.dumps({"request_id": "b", "map_id": "labelled", "operation": "dance"}))
    go = lambda: serve(spark, f"file://{inbox}", maps, f"file://{outbox}", f"file://{tmp_path}/state").awaitTermination(240)
    assert go()
    got = {r.request_id: r for r in spark.read.parquet(f"file://{outbox}").collect()}
    assert set(got) == {"a", "b"} and got["a"].statusCode == 200 and (got["b"].statusCode, got["b"].body) == (171, "no such operation")
    (inbox / "two.json").write_text(json.dumps({"request_id": "c", "map_id": "nowhere", "operation": "split"}))
    assert go()  # only what is new is answered
    got = {(r.batch, r.request_id): r.statusCode for r in spark.read.parquet(f"file://{outbox}").collect()}
    assert sorted(got) == [(0, "a"), (0, "b"), (1, "c")] and got[1, "c"] == 190 and len(SCHEMA.split(",")) >= 5
    body = json.loads(next(r.body for r in spark.read.parquet(f"file://{outbox}").collect() if r.request_id == "a"))
    source.write_labels(spark.createDataFrame([("labelled", json.dumps(body)), ("other", "{}")], "map_id string, body string"), f"file://{tmp_path}/labels")
    read = {r.map_id: json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/labels").collect()}
    assert read == {"labelled": body, "other": {}}


def test_landmarks_in_walking_order(spark, tmp_path):
    """Rooms in a row, the largest last: kept landmarks follow the walk from it, those of a room as stored."""
    img = np.zeros((60, 160), np.uint8)
    img[2:58, 2:158] = 254
    folder = tmp_path / "row"
    folder.mkdir()
    (folder / "saved_map.png").write_bytes(source.encode_png(img))
    (folder / "saved_map.json").write_text(json.dumps({"resolution": 0.05, "origin": [0.0, 0.0]}))
    room = lambda i, x0, x1: {"name": f"N{i}", "id": f"ROOM_00{i}", "type": "polygon", "geometry": [x0, 0.2, x0, 2.8, x1, 2.8, x1, 0.2, x0, 0.2], "colorType": 1, "graph": [], "groundMaterial": None}
    mark = lambda i, x: {"geometry": [x, 1.0, 0.0], "id": f"PLATFORM_LANDMARK_00{int(x)}", "roomId": f"ROOM_00{i}", "name": "m", "type": "pose"}
    data = [room(1, 0.2, 1.2), room(2, 1.2, 2.2), room(3, 2.2, 3.2), room(4, 3.2, 7.6), mark(1, 0.5), mark(4, 6.0), mark(4, 5.0)]
    (folder / "labels.json").write_text(json.dumps({"version": "v", "uuid": "u", "data": data}))
    maps = source.read_maps(spark, f"file://{tmp_path}")
    requests = spark.createDataFrame([("m", "row", "merge", ["ROOM_002", "ROOM_003"], None)], "request_id string, map_id string, operation string, room_merge_list array<string>, division struct<id:string,A:array<double>,B:array<double>>")
    row = plans.run(requests, maps).first()
    marks = [i for i in json.loads(row.body)["data"] if i["type"] == "pose"]
    assert [(m["roomId"], m["geometry"][0]) for m in marks if m["roomId"] != "ROOM_002"] == [("ROOM_004", 6.0), ("ROOM_004", 5.0), ("ROOM_001", 0.5)]
    assert [m["roomId"] for m in marks] == ["ROOM_004", "ROOM_004", "ROOM_002", "ROOM_001"]
    assert [m["id"] for m in marks] == [f"PLATFORM_LANDMARK_00{k}" for k in (1, 2, 3, 4)]
