import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from reelquery.functions import images, infer
from reelquery.operators import scores, sheets
from reelquery.sources import files, remote, settings, sinks, tracks, writers
from reelquery.streaming import ingest


def put(path, text="x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def jpeg(spark, path, pixels):
    """Grey rows of pixels as a JPEG by the JVM's writer."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(len(pixels[0]), len(pixels), 5)
    for y, row in enumerate(pixels):
        for x, v in enumerate(row):
            image.setRGB(x, y, v << 16 | v << 8 | v)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))


def test_frames_and_new_files(spark, tmp_path):
    root = str(tmp_path / "frames")
    for n in ("clip_mp4-0001.jpg", "clip_mp4--0002.jpg", "odd.jpg"):
        put(f"{root}/clip/{n}")
    found = {r["frame"]: (r["video"], r["idx"]) for r in files.frames(spark, root).collect()}
    assert found == {"clip_mp4-0001.jpg": ("clip", 1), "clip_mp4--0002.jpg": ("clip", -2), "odd.jpg": (None, None)}
    with pytest.raises(files.MissingInput):
        files.frames(spark, str(tmp_path / "none"))
    out = str(tmp_path / "seen")
    sink = lambda df, _: df.select("frame").write.mode("append").parquet(out)
    for extra in (None, "clip_mp4-0009.jpg"):
        if extra:
            put(f"{root}/clip/{extra}")
        ingest.run_available(ingest.new_frames(spark, root), sink, str(tmp_path / "check"))
    assert sorted(r["frame"] for r in spark.read.parquet(out).collect()) == sorted([*found, "clip_mp4-0009.jpg"])


def test_exports_and_plans(spark, tmp_path):
    export = str(tmp_path / "export")
    put(f"{export}/train/images/a.jpg")
    put(f"{export}/train/labels/a.txt", "0 0 0 1 0 1 1\n")
    assert [tuple(r) for r in files.export_images(spark, export).select("split", "stem").collect()] == [("train", "a")]
    texts = files.export_labels(spark, export)
    from reelquery.operators.labels import repair_labels

    plan = repair_labels(texts)
    assert [r["ok"] for r in sinks.carry_out(plan.select("path", "text"), "rewrite").collect()] == [True]
    assert open(f"{export}/train/labels/a.txt").read() == "0 0.500000 0.500000 1.000000 1.000000\n"
    moves = spark.createDataFrame([(f"{export}/train/images/a.jpg", f"{export}/valid/images/a.jpg")], "src string, dst string")
    assert sinks.carry_out(moves, "move").first()["ok"] and os.path.exists(f"{export}/valid/images/a.jpg")
    gone = spark.createDataFrame([(f"{export}/valid/images/a.jpg",)], "path string")
    assert sinks.carry_out(gone, "delete").first()["ok"] and not os.path.exists(f"{export}/valid/images/a.jpg")
    missing = spark.createDataFrame([("/nowhere/x", "/nowhere/y", None)], "src string, dst string, label string")
    assert not sinks.carry_out(missing, "copy").first()["ok"]


def test_score_passes_and_sinks(spark, tmp_path):
    folder = str(tmp_path)
    head = "frame,video,idx,n_det,max_conf\n"
    put(f"{folder}/scores_a.csv", head + "f1,v,1,0,0.0\nf2,v,2,1,0.5\n")
    put(f"{folder}/scores_b.csv", head + "f1,v,1,2,0.75\n")
    merged = scores.merge_passes(files.score_passes(spark, folder))
    assert sorted(map(tuple, merged.collect())) == [("f1", "v", 1, 2, 0.75, 2), ("f2", "v", 2, 1, 0.5, 1)]
    sinks.write_scores(merged, f"{folder}/out")
    assert [r["frame"] for r in files.previous_scores(spark, f"{folder}/out").collect()] == ["f1", "f2"]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert files.verdict_names(spark, f"{folder}/ok.txt").count() == 0
    sinks.record_names(spark, f"{folder}/ok.txt", names("b", "a"))
    sinks.record_names(spark, f"{folder}/ok.txt", names("c", "a"))
    assert sorted(r["name"] for r in files.verdict_names(spark, f"{folder}/ok.txt").collect()) == ["a", "b", "c"]
    with pytest.raises(files.MissingInput):
        files.manifest(spark, f"{folder}/none.csv")


def test_lists_and_settings(spark, tmp_path):
    path = str(tmp_path / "urls.txt")
    put(path, "https://a\n\n# note\n  https://b  \n")
    assert [r["url"] for r in files.url_list(spark, path).collect()] == ["https://a", "https://b"]
    for bad in ("--exec=x", "-o/tmp/x", "  --cookies=x"):
        put(path, bad)
        with pytest.raises(Exception, match="option"):
            files.url_list(spark, path).collect()
    put(str(tmp_path / "o.json"), '{"a":1,"b":2}')
    got = files.offsets(spark, str(tmp_path / "o.json"), ["b=9", "c=3"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 9), ("c", 3)]
    with pytest.raises(ValueError, match="nope"):
        files.offsets(spark, None, ["nope"])
    env = str(tmp_path / ".env")
    put(env, "# c\nMY_KEY=wrong\nKEY=\"quoted\"\nexport X='ws'\nY = spaced\n")
    assert [settings.dotenv_value(env, n) for n in ("KEY", "X", "Y", "ABSENT")] == ["quoted", "ws", "spaced", None]
    assert settings.dotenv_value(str(tmp_path / "no"), "KEY") is None and settings.look_up("", None, "c") == "c"
    with pytest.raises(settings.UnsafeData, match="directory"):
        settings.check_data_yaml(str(tmp_path))


def test_upload_layouts(spark, tmp_path):
    from reelquery.operators.remote import upload_jobs

    root = str(tmp_path / "up")
    for n in ("train/a.jpg", "train/images/a.jpg", "images/b.jpg", "b.jpg", "c.jpg"):
        put(f"{root}/{n}")
    jobs = upload_jobs(files.upload_layouts(spark, root, "valid", ".jpg"))
    got = {r["name"]: (r["path"].split("up/")[1], r["split"]) for r in jobs.collect()}
    assert got == {"a.jpg": ("train/a.jpg", "train"), "b.jpg": ("images/b.jpg", "valid"), "c.jpg": ("c.jpg", "valid")}


def test_search_source(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    records = [{"id": str(i), "name": f"n{i}", "split": "train" if i % 2 else None, "annotations": {"count": i, "classes": {"x": i}}} for i in range(250)]
    put(path, "\n".join(map(json.dumps, records)))
    spark.dataSource.register(remote.SearchSource)
    read = lambda **o: spark.read.format("image_search").options(path=path, total=300, **o).load()
    assert read().count() == 250 and read(split="train").count() == 125
    assert read().where("id = '7'").first()["annotations"]["classes"] == {"x": 7}


def test_search_reads_to_the_end(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    put(path, "\n".join(json.dumps({"id": str(i), "name": f"n{i}"}) for i in range(250)))
    spark.dataSource.register(remote.SearchSource)
    read = lambda **o: spark.read.format("image_search").options(path=path, **o).load()
    for found in (read(), read(total=120), read(total=1000), read(total=0)):
        assert sorted(int(r["id"]) for r in found.collect()) == list(range(250))
    assert read(fields="id").where("name is not null").count() == 0
    put(path, "")
    assert read().count() == 0


def test_failed_rows_touch_no_file(spark, tmp_path):
    label, picture = str(tmp_path / "a.txt"), str(tmp_path / "p.jpg")
    put(label, "0 0.5 0.5 0.1 0.1\n")
    put(picture, "x")
    plan = spark.createDataFrame([(label, None), (str(tmp_path / "b.txt"), "new"), (None, "t")], "path string, text string")
    done = sinks.carry_out(plan.coalesce(1), "rewrite").collect()
    assert [r["ok"] for r in done] == [False, True, False] and all(r["error"] for r in done if not r["ok"])
    assert open(label).read() == "0 0.5 0.5 0.1 0.1\n" and open(tmp_path / "b.txt").read() == "new"
    copies = [(None, str(tmp_path / "out/q.jpg"), None), (picture, str(tmp_path / "out/p.jpg"), str(tmp_path / "out/p.txt"))]
    done = sinks.carry_out(spark.createDataFrame(copies, "src string, dst string, label string").coalesce(1), "copy").collect()
    assert [r["ok"] for r in done] == [False, True] and sorted(os.listdir(tmp_path / "out")) == ["p.jpg", "p.txt"]
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt", "out", "p.jpg"]


def test_remote_writers(spark, tmp_path):
    path, log, picture = str(tmp_path / "r.jsonl"), str(tmp_path / "log"), str(tmp_path / "a.jpg")
    put(path, json.dumps({"id": "1", "annotation": {"boxes": [{"type": "polygon"}]}}) + "\n")
    put(picture, "x")
    options = {"path": path, "log": log, "key": "K1"}
    jobs = spark.createDataFrame([("a.jpg", picture, "train"), ("b.jpg", "/nowhere/K1/b.jpg", "valid")], "name string, path string, split string")
    sent = {r["name"]: r for r in writers.upload(jobs, options, "batch", ["t"]).collect()}
    assert sent["a.jpg"]["ok"] and not sent["b.jpg"]["ok"] and "K1" not in sent["b.jpg"]["error"]
    assert sorted(map(tuple, writers.jobs_per_split(jobs).collect())) == [("train", 1), ("valid", 1)]
    images = spark.createDataFrame([("1", "x&y.jpg"), ("2", "z.jpg")], "id string, name string")
    assert [r["ok"] for r in writers.mark_null(images, options).collect()] == [True, True]
    actions = spark.createDataFrame([("1", "add")], "id string, op string")
    assert writers.set_tags(actions, options, ["done"]).first()["ok"]
    calls = [json.load(open(os.path.join(log, f))) for f in os.listdir(log)]
    assert sorted(c["call"] for c in calls) == ["annotation", "annotation", "tags", "upload"]
    null = next(c for c in calls if c.get("name") == "x&y.xml")
    assert null["text"] == (
        "<annotation><folder></folder><filename>x&amp;y.jpg</filename><size><width>1920</width><height>1080</height>"
        "<depth>3</depth></size><segmented>0</segmented></annotation>"
    )
    got = {r["id"]: r for r in writers.annotations(images, options, "boxes array<struct<type:string>>").collect()}
    assert got["1"]["annotation"]["boxes"][0]["type"] == "polygon" and not got["2"]["ok"] and got["2"]["annotation"] is None
    assert [r["name"] for r in writers.preview(images, n=1).collect()] == ["x&y.jpg"]


def test_key_never_shows():
    def send():
        raise OSError("401 https://x?api_key=K1 Unauthorized")

    with pytest.raises(remote.ApiError) as e:
        remote.call(send, "K1")
    assert "K1" not in str(e.value) and "Unauthorized" in str(e.value) and e.value.__context__ is None


def test_pictures(spark, tmp_path):
    root = str(tmp_path / "pics")
    jpeg(spark, f"{root}/flat.jpg", [[120] * 64 for _ in range(36)])
    jpeg(spark, f"{root}/busy.jpg", [[255 if (x // 8 + y // 8) % 2 else 0 for x in range(64)] for y in range(36)])
    put(f"{root}/broken.jpg", "no picture")
    found = files.pictures(spark, root).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("n"), images.flatness().alias("f"), images.descriptor().alias("d")
    )
    got = {r["n"]: r for r in found.collect()}
    assert got["flat.jpg"]["f"] == 1.0 and got["busy.jpg"]["f"] < 0.8 and got["broken.jpg"]["f"] == 1.0
    assert len(got["flat.jpg"]["d"]) == 3072 and abs(got["flat.jpg"]["d"][0] - 120 / 255) < 0.01
    assert got["broken.jpg"]["d"] is None


def test_detector(spark):
    def make():
        return lambda paths: [([0.5] * len(p), [1] * len(p)) for p in paths]

    table = spark.createDataFrame([("ab",), ("",)], "path string")
    got = table.select("path", infer.detector(make)("path").alias("d")).collect()
    assert {r["path"]: list(r["d"]["conf"]) for r in got} == {"ab": [0.5, 0.5], "": []}


def test_tracking(spark, tmp_path):
    rows = [("v", 0, 0, 0.0, 0.0), ("v", 0, 1, 100.0, 0.0), ("v", 1, 0, 103.0, 1.0), ("v", 1, 1, 2.0, 2.0), ("v", 2, 0, 500.0, 0.0)]
    table = spark.createDataFrame(rows, "video string, frame long, det int, x double, y double")
    expected = [("v", 0, 0, 1), ("v", 0, 1, 2), ("v", 1, 0, 2), ("v", 1, 1, 1), ("v", 2, 0, 3)]
    assert sorted(map(tuple, ingest.track_batch(table).collect())) == expected
    source = str(tmp_path / "in")
    for k in range(3):
        table.where(F.col("frame") == k).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        q = ingest.track(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "check")
        ).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == expected


assert sys.version_info >= (3, 10)


def test_videos_caches_and_places(spark, tmp_path):
    root = str(tmp_path / "raw")
    for name in ("b.mp4", "a.mp4", "c.mov", "deep/d.mp4"):
        put(f"{root}/{name}")
    assert [r["video"] for r in files.videos(spark, root, ".mp4").collect()] == ["a", "b"]
    assert [r["video"] for r in files.videos(spark, root, "mov").collect()] == ["c"]
    with pytest.raises(files.MissingInput):
        files.videos(spark, root, "avi")
    export = str(tmp_path / "export")
    for name in ("train/labels.cache", "train/labels/a.txt", "x/y/z.cache"):
        put(f"{export}/{name}")
    plan = files.stale_caches(spark, export)
    assert plan.count() == 2
    assert all(r["ok"] for r in sinks.carry_out(plan, "delete").collect())
    assert files.stale_caches(spark, export).count() == 0 and os.path.exists(f"{export}/train/labels/a.txt")
    assert sheets.places("background", "/m/", "/d") == ("bg", "/m/contact_bg", "/d/backgrounds")
    assert sheets.places("positive", "/m", "/d") == ("positive", "/m/contact_positive", "/d/to_annotate")
    assert sheets.places("background", "/m", "/d", "/e").dest == "/e"


def test_cached_tracks(spark, tmp_path):
    root, made = str(tmp_path), []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert tracks.cached(spark, root, "k", make).count() == 1
    assert tracks.cached(spark, root, "k", make).count() == 1 and len(made) == 1
    assert tracks.cached(spark, root, "k", make, rescan=True).count() == 2
    os.remove(f"{root}/k/_SUCCESS")
    assert tracks.cached(spark, root, "k", make).count() == 3
    assert tracks.cached(spark, root, None, make).count() == 4 and sorted(os.listdir(root)) == ["k"]
