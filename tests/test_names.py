import pytest
from pyspark.sql import functions as F

from reelquery.functions import names as N
from reelquery.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("idx", [0, 1, 5, 42, 203, 9999, -1, -2, -16, -203])
def test_round_trip(spark, idx):
    found = one(spark, N.split(N.frame_name(F.lit("clip01"), F.lit(idx))))
    assert (found["video"], found["idx"]) == ("clip01", idx)


def test_sign_stands_outside_the_padding(spark):
    assert one(spark, N.frame_name(F.lit("clip"), F.lit(-16))) == "clip_mp4--0016.jpg"
    assert one(spark, N.frame_name(F.lit("clip"), F.lit(16))) == "clip_mp4-0016.jpg"
    assert one(spark, N.frame_name(F.lit("clip"), F.lit(123456))) == "clip_mp4-123456.jpg"


def test_export_suffix_last_separator_and_own_separator(spark):
    name = "clip01_mp4--0016_jpg.rf." + "0123456789abcdef" * 2 + ".jpg"
    assert tuple(one(spark, N.split(F.lit(name)))) == ("clip01", -16)
    assert tuple(one(spark, N.split(F.lit("a_mp4-b_mp4-0007.jpg")))) == ("a_mp4-b", 7)
    own = N.frame_name(F.lit("clip"), F.lit(7), sep="-frame")
    assert one(spark, own) == "clip-frame0007.jpg"
    assert tuple(one(spark, N.split(own, "-frame"))) == ("clip", 7)


def test_no_frame_name(spark):
    assert one(spark, N.try_split(F.lit("not_a_frame.jpg"))) is None
    assert one(spark, N.try_split(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="not a frame name"):
        one(spark, N.split(F.lit("not_a_frame.jpg")))


def test_parts_and_labels(spark):
    assert one(spark, N.stem(F.lit("a/b/c.tar.gz"))) == "c.tar"
    assert one(spark, N.basename(F.lit("a/b/c.jpg"))) == "c.jpg"
    assert one(spark, N.extension(F.lit("..jpg"))) == "jpg"
    assert one(spark, N.saved_name(F.lit("clip"), F.lit(42))) == "clip_f000042.jpg"
    assert one(spark, N.tile_label(F.lit("a_long_video_name"), F.lit(-16))) == "a_long_vide--016"
    assert one(spark, N.dataset_index(F.lit(10), F.lit(3))) == 7
    paths = [("a-b/x",), ("a/x",)]
    got = spark.createDataFrame(paths, "p string").orderBy(N.path_order("p")).collect()
    assert [r["p"] for r in got] == ["a/x", "a-b/x"]


def test_scalars(spark):
    high = 640
    for value, expected in ((-9.7, 0), (5.9, 5), (1e19, 640), (float("nan"), None), (float("inf"), None)):
        assert one(spark, S.clamp(F.lit(value), high)) == expected
    assert one(spark, S.scrub(F.lit("url: /x?api_key=K1 (retries)"), "K1")) == "url: /x?api_key=<redacted> (retries)"
    assert one(spark, S.scrub(F.lit("plain"), "")) == "plain"
    assert one(spark, S.first_set(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"
    assert [one(spark, S.is_true(F.lit(x))) for x in (" Yes", "no", "1", "T")] == [True, False, True, True]
    assert one(spark, S.integers(F.lit("2, 3 17"))) == [2, 3, 17]
    assert one(spark, S.step_confidence(F.lit(0.93), True)) == 0.95
    assert one(spark, S.step_confidence(F.lit(0.07), False)) == 0.05
    assert one(spark, S.step_position(F.lit(5), -10, F.lit(100))) == 0
    assert one(spark, S.seconds(F.lit(50), 0.0)) == 2.0
    assert "&lt;a&gt;" in one(spark, S.voc_xml(F.lit("<a>")))
    assert S.memory_mb(2_097_152, "darwin") == 2 and S.memory_mb(2_097_152, "linux") == 2048


def test_resolve_classes():
    vocabulary = {0: "person", 2: "car"}
    assert S.resolve_classes(vocabulary, "car,0") == [0, 2]
    assert S.resolve_classes(vocabulary, "") is None
    with pytest.raises(ValueError, match="unknown class"):
        S.resolve_classes(vocabulary, "dog")
