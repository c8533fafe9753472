"""Nested detections, events and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp

KEYPOINT = "struct<x:int,y:int,v:double>"
DETECTION = f"struct<x1:int,y1:int,x2:int,y2:int,conf:double,cls:int,track_id:int,keypoints:array<{KEYPOINT}>>"
CONF, KPT_CONF, STRIDE = 0.25, 0.5, 10
DEFAULT_NAMES = {0: "object"}


def _fail(*parts: Column | str) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def parse_detections(documents: DataFrame, width: int, height: int, text: str = "text") -> DataFrame:
    """One row per frame: the input's other columns, names, frame, dets.

    A document is {"names": {id: name}, "frames": [...]} or the list of
    frames alone; a detection is [x1, y1, x2, y2, conf, cls, track_id,
    keypoints].  Coordinates are cut to the picture.  A wrong root, a wrong
    number of fields, or a value that is no number is an error that names the
    frame.
    """
    t = F.trim(F.col(text))
    whole = F.from_json(t, "struct<names:map<string,string>,frames:array<array<array<string>>>>")
    bare = F.from_json(t, "array<array<array<string>>>")
    listed = F.startswith(t, F.lit("["))
    frames = F.when(listed, bare).otherwise(whole["frames"])
    frames = F.when(frames.isNotNull(), frames).otherwise(
        _fail("expected a list of frames, or an object with a list \"frames\"").cast("array<array<array<string>>>")
    )
    given = F.when(~listed, whole["names"])
    names = F.when(
        F.coalesce(F.size(given), F.lit(0)) > 0,
        F.map_from_entries(F.transform(F.map_entries(given), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))),
    ).otherwise(F.create_map(F.lit(0), F.lit(DEFAULT_NAMES[0])))
    each = documents.select(
        *[c for c in documents.columns if c != text], names.alias("names"), F.posexplode(frames).alias("frame", "__rq_rows")
    )

    def need(value: Column, what: str) -> Column:
        return F.coalesce(value, _fail("frame ", F.col("frame"), f": {what} is not a number").cast(value_type[what]))

    value_type = {"a coordinate": "int", "conf": "double", "cls": "int", "track_id": "int", "a visibility": "double"}

    def number(raw: Column, high: int) -> Column:
        return need(clamp(raw.try_cast("double"), high), "a coordinate")

    def keypoints(raw: Column) -> Column:
        points = F.coalesce(F.from_json(raw, "array<array<string>>"), F.array().cast("array<array<string>>"))
        return F.transform(
            points,
            lambda p: F.struct(
                number(p[0], width).alias("x"), number(p[1], height).alias("y"),
                need(p[2].try_cast("double"), "a visibility").alias("v"),
            ),
        )

    def detection(r: Column) -> Column:
        d = F.struct(
            number(r[0], width).alias("x1"), number(r[1], height).alias("y1"),
            number(r[2], width).alias("x2"), number(r[3], height).alias("y2"),
            need(r[4].try_cast("double"), "conf").alias("conf"),
            need(r[5].try_cast("double").cast("int"), "cls").alias("cls"),
            F.when(r[6].isNotNull(), need(r[6].try_cast("double").cast("int"), "track_id")).alias("track_id"),
            keypoints(r[7]).alias("keypoints"),
        )
        arity = _fail("frame ", F.col("frame"), ": a detection has ", F.size(r), " fields, expected 8")
        return F.when(F.size(r) == 8, d).otherwise(arity.cast(DETECTION))

    return each.withColumn("dets", F.transform("__rq_rows", detection)).drop("__rq_rows")


def parse_events(documents: DataFrame, total: int, text: str = "text") -> DataFrame:
    """One row per event: the input's other columns, start, end, label, n (from 1), of; ends are cut to the clip."""
    items = F.from_json(F.col(text), "array<struct<start:string,end:string,label:string>>")

    def event(e: Column) -> Column:
        a = F.greatest(F.lit(0), F.least(e["start"].cast("double").cast("int"), F.lit(total - 1)))
        b = F.greatest(F.lit(0), F.least(e["end"].cast("double").cast("int"), F.lit(total - 1)))
        s = F.struct(a.alias("start"), b.alias("end"), F.coalesce(e["label"], F.lit("event")).alias("label"))
        return F.when(a <= b, s).otherwise(_fail("event: start ", a, " is after end ", b).cast("struct<start:int,end:int,label:string>"))

    ordered = F.array_sort(F.transform(items, event))
    keys = [c for c in documents.columns if c != text]
    return documents.select(*keys, F.size(ordered).alias("of"), F.posexplode(ordered).alias("n", "e")).select(
        *keys, "e.start", "e.end", "e.label", (F.col("n") + 1).alias("n"), "of"
    )


def filtered(dets: Column | str, conf: float = CONF, keep: list[int] | None = None) -> Column:
    """Detections of at least `conf`, and of the kept classes (None: all); NaN is no confidence."""
    kept = F.array(*[F.lit(k) for k in keep]) if keep else None

    def ok(d: Column) -> Column:
        sure = (d["conf"] >= conf) & ~F.isnan(d["conf"])
        return sure & F.array_contains(kept, d["cls"]) if kept is not None else sure

    return F.filter(dets, ok)


def visible_keypoints(dets: Column | str, threshold: float = KPT_CONF) -> Column:
    return F.transform(dets, lambda d: d.withField("keypoints", F.filter(d["keypoints"], lambda p: p["v"] >= threshold)))


def keypoints(xy: Column, conf: Column) -> Column:
    """struct(x, y, v) per point: whole coordinates, v of 3 places, 1.0 where the model gives none."""
    return F.coalesce(
        F.transform(
            xy,
            lambda p, i: F.struct(
                p[0].cast("int").alias("x"), p[1].cast("int").alias("y"),
                F.coalesce(F.round(F.get(conf, i), 3), F.lit(1.0)).alias("v"),
            ),
        ),
        F.array().cast(f"array<{KEYPOINT}>"),
    )


def unique_tracks(detections: DataFrame) -> DataFrame:
    """tracks per cls: distinct non-null track_id."""
    return detections.groupBy("cls").agg(F.countDistinct("track_id").alias("tracks"))


def class_name(names: Column, cls: Column) -> Column:
    return F.coalesce(F.try_element_at(names, cls), cls.cast("string"))


def overlay_stats(detections: DataFrame, frame: list[str]) -> DataFrame:
    """Per frame: n_det, max_conf, and 'name:n ...' by class id.  Input: frame keys, cls, name, conf."""
    per = detections.groupBy(*frame, "cls", "name").agg(F.count("*").alias("n"), F.max("conf").alias("m"))
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("cls", "name", "n"))),
            lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string")),
        ),
        " ",
    )
    return per.groupBy(*frame).agg(F.sum("n").alias("n_det"), F.max("m").alias("max_conf"), text.alias("classes"))


def numbered_events(events: DataFrame, by: str = "video") -> DataFrame:
    """Adds n and of: place among the video's events in (start, end, label) order."""
    w = Window.partitionBy(by)
    return events.withColumn("n", F.row_number().over(w.orderBy("start", "end", "label"))).withColumn("of", F.count("*").over(w))


def active_event(points: DataFrame, events: DataFrame, by: str = "video", cell: int = 64) -> DataFrame:
    """The first event (by start, end, label) that holds each point (`by`, idx): start, end, label, n, of.

    Events are laid over cells of indices, so the interval join is an
    equi-join on cells; points in no event are not returned.
    """
    laid = numbered_events(events, by).withColumn(
        "__rq_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    )
    places = points.select(by, "idx").distinct().withColumn("__rq_cell", F.floor(F.col("idx") / cell))
    hit = places.join(laid, [by, "__rq_cell"]).where(F.col("idx").between(F.col("start"), F.col("end")))
    first = hit.groupBy(by, "idx").agg(F.min(F.struct("n", "start", "end", "label", "of")).alias("__rq_e"))
    # Points that repeat one another stay as many as they are.
    met = points.join(first, [by, "idx"])
    return met.select(*[points[c] for c in points.columns], *[F.col(f"__rq_e.{c}") for c in ("start", "end", "label", "n", "of")])


def next_start(points: DataFrame, starts: DataFrame, by: str = "video", backward: bool = False) -> DataFrame:
    """Adds target and wrapped: the nearest start strictly after (before) idx, else the first (last) one.

    Points and starts are sorted once per video, from the far end, and each
    point takes the last start met so far: one running value, no pairs.
    """
    sign = -1 if backward else 1
    marks = starts.select(by, (sign * F.col("start")).cast("bigint").alias("__rq_x"))
    both = points.withColumns({"__rq_x": (sign * F.col("idx")).cast("bigint"), "__rq_s": F.lit(None).cast("bigint")})
    both = both.unionByName(marks.withColumn("__rq_s", F.col("__rq_x")), allowMissingColumns=True)
    # A point comes before the starts of its own index, so these are not ahead of it.
    w = Window.partitionBy(by).orderBy(F.desc("__rq_x"), F.col("__rq_s").isNull().desc())
    both = both.withColumns(
        {
            "__rq_ahead": F.last("__rq_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "__rq_first": F.min("__rq_s").over(Window.partitionBy(by)),
        }
    ).where("__rq_s is null")
    return both.select(
        *points.columns,
        (sign * F.coalesce("__rq_ahead", "__rq_first")).alias("target"),
        (F.col("__rq_ahead").isNull() & F.col("__rq_first").isNotNull()).alias("wrapped"),
    )


def next_detection(
    probes: DataFrame, frames: DataFrame, stride: int = STRIDE, limit: int = 0, backward: bool = False, by: str = "video"
) -> DataFrame:
    """Adds target: the next frame with detections on the stride lattice from idx, wrapping once; null if none.

    probes: `by`, idx, total; frames: `by`, frame (those with detections).
    Steps are multiples of `stride`; past the end the lattice starts again at
    frame 0, once.  At most ceil(limit / stride) frames are looked at (limit
    0: the clip's length).  A lattice is a residue class, so each probe needs
    one look-up in its own class and one in the class of the restart, where a
    walk would look at every step.  Backward is forward on mirrored indices.
    """
    mirror = lambda c: (F.col("total") - 1 - c) if backward else c
    totals = probes.select(by, "total").distinct()
    seen = frames.join(totals, by).where(F.col("frame").between(0, F.col("total") - 1))
    seen = seen.select(by, mirror(F.col("frame")).cast("bigint").alias("__rq_x"))
    both = probes.withColumns({"__rq_x": mirror(F.col("idx")).cast("bigint"), "__rq_f": F.lit(None).cast("bigint")})
    both = both.unionByName(seen.withColumn("__rq_f", F.col("__rq_x")), allowMissingColumns=True)
    w = Window.partitionBy(by, F.pmod("__rq_x", F.lit(stride))).orderBy(F.desc("__rq_x"), F.col("__rq_f").isNull().desc())
    ahead = F.last("__rq_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("__rq_ahead", ahead).where("__rq_f is null")
    restart = seen.where(F.col("__rq_x") % stride == 0).groupBy(by).agg(F.min("__rq_x").alias("__rq_again"))
    most = F.ceil((F.lit(limit) if limit else F.col("total")) / stride)
    steps_left = F.floor((F.col("total") - 1 - F.col("__rq_x")) / stride)
    next_, again = F.col("__rq_ahead"), F.col("__rq_again")
    direct = F.when((next_ - F.col("__rq_x")) / stride <= most, next_)
    wrapped = F.when(next_.isNull() & (steps_left + again / stride + 1 <= most), again)
    return found.join(restart, by, "left").select(
        *[found[c] for c in probes.columns], mirror(F.coalesce(direct, wrapped)).cast("bigint").alias("target")
    )


def reconcile(frames: DataFrame, total: int) -> DataFrame:
    """frame 0 .. total-1, dets (empty where the pass has none)."""
    every = frames.sparkSession.range(total).select(F.col("id").cast("int").alias("frame"))
    kind = frames.schema["dets"].dataType
    return every.join(frames, "frame", "left").withColumn("dets", F.coalesce("dets", F.array().cast(kind)))
