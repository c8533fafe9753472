import random
import time

import pytest
from pyspark.sql import functions as F

from reelquery.operators import dedup, detections, labels, remote, sample, scores, select, sheets, stats


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_score_and_merge(spark):
    frames = spark.createDataFrame([("a",), ("b",)], "frame string")
    found = spark.createDataFrame([("a", 0.5), ("a", 0.91239), ("b", 0.01), ("b", float("nan"))], "frame string, conf double")
    assert rows(scores.score_frames(frames, found), "frame", "n_det", "max_conf") == [("a", 2, 0.9124), ("b", 0, 0.0)]
    passes = spark.createDataFrame(
        [("f", "v2", 2, 0, 0.0, "scores_b.csv", 0), ("f", "v1", 1, 3, 0.7, "scores_a.csv", 5), ("g", "v", 9, 0, 0.0, "scores_a.csv", 1)],
        "frame string, video string, idx int, n_det int, max_conf double, pass string, row_no int",
    )
    merged = scores.merge_passes(passes)
    assert rows(merged) == [("f", "v1", 1, 3, 0.7, 2), ("g", "v", 9, 0, 0.0, 1)]
    assert tuple(scores.empty_share(merged).first()) == (2, 1, 50.0)
    assert scores.empty_share(merged.where("false")).first()["percent"] == 0.0


def test_labelled_window_keeps_unparsed_names(spark):
    frames = spark.createDataFrame([("v", i) for i in range(10)] + [(None, None), ("w", 5)], "video string, idx int")
    marked = spark.createDataFrame([("v", 5), ("v", 5), (None, None)], "video string, idx int")
    kept = scores.exclude_labelled(frames, scores.labelled_frames(marked), 2)
    assert {tuple(r) for r in kept.collect()} == {("v", i) for i in (0, 1, 2, 8, 9)} | {(None, None), ("w", 5)}
    assert scores.exclude_labelled(frames, marked, -1).count() == 12


def test_selection(spark):
    disk = spark.createDataFrame([("v", i) for i in range(10)], "video string, idx int")
    picked = spark.createDataFrame([("v", 2, "f2"), ("v", 0, "f0"), ("x", 3, "f3")], "video string, idx int, frame string")
    assert rows(select.edge_trim(picked, disk, 2), "frame") == [("f2",)]
    assert select.edge_trim(picked, disk, 0).count() == 3
    flat = spark.createDataFrame([("a", 0.3), ("b", 0.31), ("c", None)], "frame string, flatness double")
    assert rows(select.not_flat(flat, 0.3), "frame") == [("a",)]
    assert select.not_flat(flat, 1.0).count() == 3
    assert [r["frame"] for r in select.in_order(picked, 2).collect()] == ["f0", "f2"]
    scored = spark.createDataFrame([(0.35,), (float("nan"),), (0.3,)], "max_conf double")
    assert select.positive(scored).count() == 1


def test_numbering_over_many_partitions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    table = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = sheets.numbered(table, ["v"]).collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(v, v) for v in range(500)]
    assert sheets.numbered(table.where("false"), ["v"]).count() == 0
    pages = sheets.paginate(table, "bg", ["v"]).where("v in (35, 36, 499)")
    assert rows(pages, "v", "sheet", "tile") == [(35, "bg_001", 36), (36, "bg_002", 1), (499, "bg_014", 32)]


def test_reject_spec_and_verdicts(spark):
    spec = lambda s: spark.createDataFrame([(s,)], "spec string")
    assert rows(sheets.parse_reject(spec("bg_002:5,17 bg_004:3"))) == [("bg_002", 5), ("bg_002", 17), ("bg_004", 3)]
    assert rows(sheets.parse_reject(spec(""))) == rows(sheets.parse_reject(spec(None))) == []
    with pytest.raises(Exception, match="expected sheet"):
        sheets.parse_reject(spec("bg_002")).collect()
    names = spark.createDataFrame([(n,) for n in "cab"], "name string")
    assert rows(sheets.record_verdicts(names, "2")) == [("a", "verified"), ("b", "rejected"), ("c", "verified")]
    with pytest.raises(ValueError, match="no such numbers"):
        sheets.record_verdicts(names, "9")
    assert rows(sheets.pending(names, names.where("name = 'a'"), names.where("name = 'b'"))) == [("c",)]


def walk(frames, n):
    """The sampler, walked step by step."""
    by_video = {}
    for f in sorted(frames):
        by_video.setdefault(f[1] or "", []).append(f)
    for v in by_video.values():
        v.sort(key=lambda f: (f[2] or 0, f[0]))
    at, out = dict.fromkeys(by_video, 0.0), []
    while len(out) < n and any(int(at[v]) < len(by_video[v]) for v in by_video):
        for v in sorted(by_video):
            if len(out) < n and int(at[v]) < len(by_video[v]):
                out.append(by_video[v][int(at[v])])
                at[v] += max(1, len(by_video[v]) * len(by_video) / n)
    return sorted(f[0] for f in out)


@pytest.mark.parametrize("n", [1, 3, 10, 20, 50])
def test_subsample(spark, n):
    rng = random.Random(n)
    frames = [(f"{v}{i:03d}", v, i) for v in "abc" for i in range(rng.choice([1, 7, 100]))] + [("odd", None, None)]
    table = spark.createDataFrame(frames, "frame string, video string, idx int")
    assert [r["frame"] for r in sample.subsample(table, n).collect()] == walk(frames, n)


def test_label_repair(spark):
    texts = {
        "poly": "0 0.10 0.20 0.30 0.20 0.30 0.60 0.10 0.60\n\n 1  0.5 0.5 0.1 0.1 ",
        "box": "1 0.5 0.5 0.1 0.1", "odd": "0 0.1 0.2 0.3 0.4 0.5 0.6 0.7", "class7": "7 0.0 0.0 1.0 1.0 0.5 0.5",
    }
    table = spark.createDataFrame(list(texts.items()), "stem string, text string")
    got = {r["stem"]: (r["n_polygons"], r["text"]) for r in labels.repair_labels(table).collect()}
    assert got["poly"] == (1, "0 0.200000 0.400000 0.200000 0.400000\n1 0.5 0.5 0.1 0.1\n")
    assert got["odd"] == (1, None)
    assert got["class7"][1].startswith("7 ") and "box" not in got


def test_zero_boxes_and_splits(spark):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "c")], "split string, stem string")
    files = spark.createDataFrame([("train", "a", "0 1 1 1 1"), ("train", "b", " \n")], "split string, stem string, text string")
    assert rows(labels.zero_box(images, files, ["split", "stem"]), "stem") == [("b",), ("c",)]
    assert rows(labels.split_counts(images), "split", "n") == [("test", 1), ("train", 2), ("valid", 0)]


def test_near_duplicates_lose_no_pair(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    items = [
        (i, rng.choice(["train", "valid", "test"]), [x + rng.uniform(-0.25, 0.25) for x in base[i % 6]]) for i in range(60)
    ]
    table = spark.createDataFrame(items, "id int, split string, v array<double>")
    rank = {"train": 1, "valid": 2, "test": 3}
    expected = set()
    for a in items:
        for b in items:
            diff = sum(abs(x - y) for x, y in zip(a[2], b[2], strict=True)) / 16
            if (rank[a[1]], a[0]) < (rank[b[1]], b[0]) and a[1] != b[1] and diff < 0.15:
                expected.add((a[0], b[0]))
    pairs = dedup.near_duplicates(table, 0.15)
    assert {(r["a_id"], r["b_id"]) for r in pairs.collect()} == expected and expected
    assert {r["id"] for r in dedup.moves(pairs).collect()} == {b for _, b in expected}
    eval_ids = {i for i, s, _ in items if s != "train"}
    assert {r["id"] for r in dedup.settled(pairs).collect()} == {x for p in expected for x in p} & eval_ids


def frames_of(spark, text, width=640, height=480):
    return detections.parse_detections(spark.createDataFrame([(text,)], "text string"), width, height).collect()


def test_detection_documents(spark):
    got = frames_of(spark, '[[[-9,-9,1e19,5,0.5,0,null,[[-4,99999999999999999999,0.25]]]],[]]')
    d = got[0]["dets"][0]
    assert (d["x1"], d["y1"], d["x2"], d["y2"], d["track_id"]) == (0, 0, 640, 5, None)
    assert [tuple(k) for k in d["keypoints"]] == [(0, 480, 0.25)] and got[1]["dets"] == []
    assert got[0]["names"] == {0: "object"}
    for text, error in (
        ('{"names":{"0":"person"}}', "frames"), ('[[[1,2,3,4,0.5,0,null,[]]],[[1,2,3,4,5,6]]]', "frame 1.*6 fields"),
        ('[[[NaN,2,3,4,0.5,0,null,[]]]]', "frame 0"), ('[[["x",2,3,4,0.5,0,null,[]]]]', "frame 0"),
        ('[[[Infinity,2,3,4,0.5,0,null,[]]]]', "frame 0"),
    ):
        with pytest.raises(Exception, match=f"(?s){error}"):
            frames_of(spark, text)


def test_events(spark):
    def read(text):
        return rows(detections.parse_events(spark.createDataFrame([(text,)], "text string"), 2090), "start", "end", "label", "n")

    text = '[{"start":-5,"end":99999,"label":"hand_up"},{"start":5000,"end":6000},{"start":-50,"end":-10}]'
    assert read(text) == [(0, 0, "event", 1), (0, 2089, "hand_up", 2), (2089, 2089, "event", 3)]
    with pytest.raises(Exception, match="after end"):
        read('[{"start":90,"end":10}]')


def test_keypoints_and_filters(spark):
    kind = "array<" + detections.DETECTION + ">"
    dets = [(10, 10, 110, 70, 0.8, 0, 7, [(30, 40, 0.9), (90, 40, 0.1)]), (0, 0, 1, 1, float("nan"), 1, None, [])]
    table = spark.createDataFrame([(dets,)], f"dets {kind}")
    seen = table.select(detections.visible_keypoints("dets").alias("d")).first()["d"]
    assert [k["x"] for k in seen[0]["keypoints"]] == [30]
    assert len(table.select(detections.filtered("dets", 0.25).alias("d")).first()["d"]) == 1
    assert table.select(detections.filtered("dets", 0.25, [1]).alias("d")).first()["d"] == []
    points = spark.range(1).select(
        detections.keypoints(F.array(F.array(F.lit(1.9), F.lit(2.1))), F.lit(None).cast("array<double>")).alias("k")
    ).first()["k"]
    assert [tuple(p) for p in points] == [(1, 2, 1.0)]


def scan(idx, total, stride, limit, full, sign):
    """The lattice walk, step by step."""
    limit, step, at, wrapped, seen = limit or total, sign * stride, idx, False, 0
    while seen < limit:
        at += step
        if not 0 <= at < total:
            if wrapped:
                return None
            at, wrapped = (0 if sign > 0 else total - 1), True
        if at in full:
            return at
        seen += stride
    return None


@pytest.mark.parametrize("sign", [1, -1])
def test_next_detection_walks_the_lattice(spark, sign):
    rng = random.Random(sign)
    for stride, limit in ((1, 0), (3, 0), (10, 25), (4, 7)):
        probes, frames, expected = [], [], {}
        for v in range(30):
            total = rng.randint(1, 40)
            full = {f for f in range(total) if rng.random() < 0.15}
            frames += [(v, f) for f in full] + [(v, total + 3)]
            for idx in {rng.randrange(total) for _ in range(3)}:
                probes.append((v, idx, total))
                expected[v, idx] = scan(idx, total, stride, limit, full, sign)
        got = detections.next_detection(
            spark.createDataFrame(probes, "video int, idx int, total int"),
            spark.createDataFrame(frames, "video int, frame int"), stride, limit, backward=sign < 0,
        )
        assert {(r["video"], r["idx"]): r["target"] for r in got.collect()} == expected


def test_long_videos_and_repeated_points(spark):
    n = 80_000
    points = spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("idx"))
    starts = spark.createDataFrame([("v", 10), ("v", 50_000)], "video string, start long")
    began = time.perf_counter()
    found = detections.next_start(points, starts).groupBy("target", "wrapped").count().collect()
    assert sorted(map(tuple, found)) == [(10, False, 10), (10, True, n - 50_000), (50_000, False, 49_990)]
    probes = points.withColumn("total", F.lit(n))
    frames = spark.createDataFrame([("v", 60_000), ("v", 60_001)], "video string, frame long")
    found = detections.next_detection(probes, frames, stride=2).groupBy("target").count().collect()
    # Ahead on the probe's own lattice; else the even one, where the walk starts again.
    assert dict(map(tuple, found)) == {60_000: 40_000 + 10_000, 60_001: 30_000}
    assert time.perf_counter() - began < 60  # seconds; a frame computed anew per row takes minutes
    events = spark.createDataFrame([("v", 0, 9, "a")], "video string, start long, end long, label string")
    twice = spark.createDataFrame([("v", 3), ("v", 3), ("v", 30)], "video string, idx long")
    assert detections.active_event(twice, events).count() == 2


def test_reconcile_and_tracks(spark):
    frames = spark.createDataFrame([(1, [1, 2]), (9, [3])], "frame int, dets array<int>")
    assert rows(detections.reconcile(frames, 3)) == [(0, []), (1, [1, 2]), (2, [])]
    ids = spark.createDataFrame([(0, 1), (0, 1), (0, None), (1, None)], "cls int, track_id int")
    assert rows(detections.unique_tracks(ids)) == [(0, 1), (1, 0)]


def test_remote_planning(spark):
    boxes = [[("polygon", None)], [(None, None), ("polygon", None)], [(None, [1.0])], None]
    table = spark.createDataFrame([(b,) for b in boxes], "boxes array<struct<type:string,points:array<double>>>")
    assert tuple(remote.polygon_progress(table).first()) == (3, 1, 1)
    table = spark.createDataFrame([(i,) for i in range(10)], "id int")
    asked = []

    def sweep(i):
        asked.append(i)
        return table.where(F.col("id") % (2 if i == 0 else 1) == 0).withColumns({"sweep": F.lit(i), "offset": F.lit(0)})

    assert remote.sweep_until_quiet(sweep, "id", ["sweep", "offset"]).count() == 10 and asked == [0, 1, 2, 3]


def test_latency(spark):
    table = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "ms double")
    got = stats.latency_summary(table, "ms").first()
    assert (got["median"], got["p90"], got["least"]) == (5.5, 10.0, 1.0)
    done = spark.createDataFrame([(False,), (None,)], "ok boolean")
    assert tuple(stats.run_summary(done).first()) == (0, 2, 1)
