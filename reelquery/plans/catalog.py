"""All queries over the standard tables, with SQL of the same rows.

The tables hold no frames, so each operator is bound to columns of the same
shape: orders are frames, line items detections, customers and users videos.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as S
from ..operators import dedup, detections, labels, remote, sample, scores, select, sheets, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DISCOUNT = 0.08
TRIM = 2


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shared bindings --------------------------------------------------------------


def on_disk(spark: SparkSession, d: str) -> DataFrame:
    """All orders as frames of their customer's video, numbered by time."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("video"),
        (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
    )


ON_DISK = """on_disk AS (
  SELECT o_orderkey AS frame, o_custkey AS video,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx FROM orders
)"""


def passes(spark: SparkSession, d: str, conf: float = DISCOUNT) -> DataFrame:
    """One detector pass per return flag over the orders that have such items."""
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("pass"), F.col("l_discount").alias("conf")
    )
    frames = items.select("frame", "pass").distinct()
    kept = items.groupBy("frame", "pass").agg(
        F.count_if(F.col("conf") >= conf).alias("n_det"),
        F.coalesce(F.round(F.max(F.when(F.col("conf") >= conf, F.col("conf"))), 4), F.lit(0.0)).alias("max_conf"),
    )
    return frames.join(kept, ["frame", "pass"]).join(on_disk(spark, d), "frame").withColumn("row_no", F.lit(0))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return scores.merge_passes(passes(spark, d))


MERGED = (
    ON_DISK
    + f""", pass AS (
  SELECT l_orderkey AS frame, l_returnflag AS pass, count(*) FILTER (l_discount >= {DISCOUNT}) AS n_det,
         coalesce(round(max(l_discount) FILTER (l_discount >= {DISCOUNT}), 4), 0.0) AS max_conf
  FROM lineitem GROUP BY ALL
), merged AS (
  SELECT p.frame, o.video, o.idx, max(n_det) AS n_det, max(max_conf) AS max_conf, count(*) AS passes
  FROM pass p JOIN on_disk o ON p.frame = o.frame GROUP BY ALL
)"""
)


def user_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("video"), "event_type", "value",
        (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
    )


USER_EVENTS = """ue AS (
  SELECT event_id, user_id AS video, event_type, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events
)"""

# Names ------------------------------------------------------------------------


@query("SELECT c_custkey, regexp_extract(c_name, '^(.*)#(.*)$', 1) AS video, CAST(regexp_extract(c_name, '^(.*)#(.*)$', 2) AS BIGINT) AS idx FROM customer")
def frame_split(spark: SparkSession, d: str) -> DataFrame:
    found = N.split("c_name", "#")
    return table(spark, d, "customer").select("c_custkey", found.alias("f")).select("c_custkey", "f.video", "f.idx")


@query(
    "SELECT o_orderkey, o_orderstatus || '_mp4-' || CASE WHEN o_orderkey < 7500 THEN '-' ELSE '' END || printf('%04d', abs(o_orderkey - 7500)) || '.jpg' AS name FROM orders"
)
def frame_name(spark: SparkSession, d: str) -> DataFrame:
    idx = F.col("o_orderkey") - 7500
    return table(spark, d, "orders").select("o_orderkey", N.frame_name("o_orderstatus", idx).alias("name"))


@query(
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem,
    (SELECT string_agg(t, '|' ORDER BY i) FROM (SELECT trim(x) AS t, i FROM (SELECT unnest(string_split(url || ', ,a b ,', ',')) AS x, unnest(range(1, 99)) AS i) WHERE x IS NOT NULL) WHERE t <> '') AS tags FROM pages"""
)
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", N.basename("url").alias("base"), N.stem("url").alias("stem"),
        F.array_join(S.listed(F.concat("url", F.lit(", ,a b ,"))), "|").alias("tags"),
    )


@query(f"WITH {USER_EVENTS} SELECT event_id, round(idx / 25.0, 2) AS seconds, substr(event_type || video, 1, 11) || '-' || printf('%04d', idx) AS label FROM ue")
def frame_seconds(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat("event_type", F.col("video").cast("string"))
    return user_events(spark, d).select(
        "event_id", F.round(S.seconds(F.col("idx"), 0.0), 2).alias("seconds"), N.tile_label(named, "idx").alias("label")
    )


@query("SELECT c_custkey, substr(sha1('v2|' || c_name || '|' || c_mktsegment || '|1280|0.05'), 1, 16) AS key FROM customer")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    key = S.cache_key(F.lit("v2"), F.col("c_name"), F.col("c_mktsegment"), F.lit("1280"), F.lit("0.05"))
    return table(spark, d, "customer").select("c_custkey", key.alias("key"))


@query(
    """SELECT n_nationkey, coalesce(nullif(CASE WHEN n_regionkey = 0 THEN n_name ELSE '' END, ''), nullif(CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE '' END, ''), 'file') AS value,
    replace(n_name || ' key=AMER', 'AMER', '<redacted>') AS scrubbed,
    '<annotation><folder></folder><filename>' || n_name || '.jpg</filename><size><width>1920</width><height>1080</height><depth>3</depth></size><segmented>0</segmented></annotation>' AS xml,
    n_name LIKE 'A%' AS yes FROM nation"""
)
def settings(spark: SparkSession, d: str) -> DataFrame:
    name, region = F.col("n_name"), F.col("n_regionkey")
    return table(spark, d, "nation").select(
        "n_nationkey",
        S.first_set(F.when(region == 0, name).otherwise(""), F.when(region == 1, F.lower(name)).otherwise(""), F.lit("file")).alias("value"),
        S.scrub(F.concat(name, F.lit(" key=AMER")), "AMER").alias("scrubbed"),
        S.voc_xml(F.concat(name, F.lit(".jpg"))).alias("xml"),
        S.is_true(F.when(F.startswith(name, F.lit("A")), " Yes").otherwise("no")).alias("yes"),
    )


@query(
    "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(l) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE l IS NOT NULL AND trim(l) <> '' AND trim(l) NOT LIKE '#%' AND trim(l) NOT LIKE '-%'"
)
def url_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    line = F.trim("l")
    kept = lines.where((line != "") & ~F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("-")))
    return kept.select("doc_id", "line_no", line.alias("line"))


@query("SELECT count(*) AS n, event_type FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def resolve_classes(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = dict(enumerate(["click", "error", "purchase", "signup", "view"]))
    wanted = S.resolve_classes(vocabulary, "view, 0") or []
    events = table(spark, d, "events").where(F.col("event_type").isin([vocabulary[i] for i in wanted]))
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


# Scores -----------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS frame, count(l_orderkey) AS n_det, coalesce(round(max(l_discount), 4), 0.0) AS max_conf FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount >= 0.05 GROUP BY o_orderkey"
)
def score_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_discount").alias("conf"))
    return scores.score_frames(frames, found, 0.05)


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_passes(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)


@query(f"WITH {MERGED} SELECT count(*) AS total, count(*) FILTER (n_det = 0) AS empty, round(100.0 * count(*) FILTER (n_det = 0) / greatest(count(*), 1), 6) AS percent FROM merged")
def empty_share(spark: SparkSession, d: str) -> DataFrame:
    return scores.empty_share(merged(spark, d)).withColumn("percent", F.round("percent", 6))


@query(
    f"""WITH {USER_EVENTS}, lab AS (SELECT DISTINCT video, idx FROM ue WHERE event_type = 'error' AND value > 100)
    SELECT event_id, video, idx FROM ue WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.video = ue.video AND ue.idx BETWEEN lab.idx - 2 AND lab.idx + 2)"""
)
def labelled_window_anti(spark: SparkSession, d: str) -> DataFrame:
    events = user_events(spark, d)
    marked = scores.labelled_frames(events.where("event_type = 'error' and value > 100"))
    return scores.exclude_labelled(events, marked, 2).select("event_id", "video", "idx")


@query("SELECT o_orderkey AS frame FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.05)")
def rescore_semi(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"))
    return scores.rescore_candidates(frames, score_frames(spark, d))


# Selection --------------------------------------------------------------------


@query(f"WITH {MERGED} SELECT frame, video, idx FROM merged WHERE n_det = 0")
def select_background(spark: SparkSession, d: str) -> DataFrame:
    return select.in_order(select.background(merged(spark, d))).select("frame", "video", "idx")


@query(f"WITH {MERGED} SELECT frame, video, idx, max_conf FROM merged WHERE max_conf >= 0.1 ORDER BY video, idx, frame LIMIT 100")
def select_positive(spark: SparkSession, d: str) -> DataFrame:
    return select.in_order(select.positive(merged(spark, d), 0.1), 100).select("frame", "video", "idx", "max_conf")


TRIMMED = (
    MERGED
    + f""", span AS (SELECT video, min(idx) AS lo, max(idx) AS hi FROM on_disk GROUP BY video), trimmed AS (
  SELECT m.* FROM merged m JOIN span s ON m.video = s.video WHERE m.n_det = 0 AND m.idx BETWEEN s.lo + {TRIM} AND s.hi - {TRIM})"""
)


def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return select.edge_trim(select.background(merged(spark, d)), on_disk(spark, d), TRIM)


@query(f"WITH {TRIMMED} SELECT frame, video, idx FROM trimmed")
def edge_trim(spark: SparkSession, d: str) -> DataFrame:
    return trimmed(spark, d).select("frame", "video", "idx")


BLOCKS = """b AS (SELECT vec_id, i // 8 AS block, x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings)),
 flat AS (SELECT vec_id, avg(CASE WHEN sd < 0.1 THEN 1.0 ELSE 0.0 END) AS flatness FROM (SELECT vec_id, block, stddev_pop(CAST(x AS DOUBLE)) AS sd FROM b GROUP BY ALL) GROUP BY vec_id)"""


def flatness_of(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    blocks = cells.select("vec_id", F.floor(F.col("i") / 8).alias("block"), F.col("x").cast("double").alias("value"))
    return select.flatness(blocks, "vec_id", 0.1)


@query(f"WITH {BLOCKS} SELECT vec_id, flatness FROM flat WHERE flatness <= 0.30")
def flatness_rel(spark: SparkSession, d: str) -> DataFrame:
    return select.not_flat(flatness_of(spark, d), 0.30)


# Sheets and verdicts ------------------------------------------------------------

MANIFEST = (
    TRIMMED
    + """, manifest AS (SELECT printf('background_%03d', n // 36 + 1) AS sheet, CAST(n % 36 + 1 AS INTEGER) AS tile, frame, video, idx
  FROM (SELECT *, row_number() OVER (ORDER BY video, idx, frame) - 1 AS n FROM trimmed))"""
)


@query(f"WITH {MANIFEST} SELECT sheet, tile, frame FROM manifest")
def sheet_manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = sheets.paginate(trimmed(spark, d).select("frame", "video", "idx"), "background", ["video", "idx", "frame"])
    return pages.select("sheet", "tile", "frame")


SPEC = "background_001:1,5,36 background_002:3"


@query(
    f"""WITH {MANIFEST}, spec AS (SELECT string_split(w, ':')[1] AS sheet, CAST(unnest(string_split(string_split(w, ':')[2], ',')) AS INTEGER) AS tile
    FROM (SELECT unnest(string_split('{SPEC}', ' ')) AS w))
    SELECT sheet, tile, frame FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM spec s WHERE s.sheet = m.sheet AND s.tile = m.tile) AND frame % 7 <> 0"""
)
def reject_apply(spark: SparkSession, d: str) -> DataFrame:
    rejects = sheets.parse_reject(spark.createDataFrame([(SPEC,)], "spec string"))
    by_name = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("name"))
    return sheets.apply_rejects(sheet_manifest(spark, d), rejects, by_name).select("sheet", "tile", "frame")


def unjudged(spark: SparkSession, d: str) -> DataFrame:
    named = F.format_string("doc%06d", "doc_id").alias("name")
    judged = table(spark, d, "labels")
    return sheets.pending(
        table(spark, d, "documents").select(named),
        judged.where("quality = 0").select(named), judged.where("toxic = 1").select(named),
    )


UNJUDGED = """p AS (SELECT printf('doc%06d', doc_id) AS name, row_number() OVER (ORDER BY printf('doc%06d', doc_id)) AS number
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1))"""


@query(f"WITH {UNJUDGED} SELECT name, number, (number - 1) // 6 + 1 AS page, CAST((number - 1) % 6 + 1 AS INTEGER) AS tile FROM p")
def verify_pages(spark: SparkSession, d: str) -> DataFrame:
    return sheets.verify_pages(unjudged(spark, d))


@query(f"WITH {UNJUDGED} SELECT name, CASE WHEN number IN (2, 3, 17) THEN 'rejected' ELSE 'verified' END AS verdict FROM p")
def record_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return sheets.record_verdicts(unjudged(spark, d), "2, 3 17")


@query("SELECT DISTINCT printf('doc%06d', doc_id) AS name FROM labels WHERE quality = 0 OR toxic = 1")
def merged_verdicts(spark: SparkSession, d: str) -> DataFrame:
    named = F.format_string("doc%06d", "doc_id").alias("name")
    judged = table(spark, d, "labels")
    return sheets.merged_verdicts(judged.where("quality = 0").select(named), judged.where("toxic = 1").select(named))


@query("SELECT printf('doc%06d', d.doc_id) AS frame, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def collect_plan(spark: SparkSession, d: str) -> DataFrame:
    named = F.format_string("doc%06d", "doc_id").alias("frame")
    return sheets.collect_plan(table(spark, d, "documents").select(named), table(spark, d, "labels").select(named))


@query(
    """WITH v AS (SELECT source AS video, count(*) AS size, (SELECT count(DISTINCT source) FROM documents) AS videos FROM documents GROUP BY source),
    s AS (SELECT *, greatest(1.0, CAST(size * videos AS DOUBLE) / 50.0) AS stride FROM v),
    k AS (SELECT *, unnest(range(0, 51)) AS k FROM s),
    p AS (SELECT video, size, k, CAST(floor(CASE WHEN k = 0 THEN 0.0 ELSE list_reduce(list_transform(range(0, k), lambda i: stride), lambda a, b: a + b) END) AS BIGINT) AS place FROM k),
    c AS (SELECT video, place FROM p WHERE place < size ORDER BY k, video LIMIT 50),
    f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)
    SELECT printf('%s_mp4-%04d.jpg', source, doc_id) AS frame, source AS video, doc_id AS idx FROM f JOIN c ON f.source = c.video AND f.place = c.place"""
)
def subsample(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "documents").select(
        N.frame_name("source", "doc_id").alias("frame"), F.col("source").alias("video"), F.col("doc_id").alias("idx")
    )
    return sample.subsample(frames, 50)


# Labels and duplicates ----------------------------------------------------------


@query(
    """SELECT vec_id, round((list_min(xs) + list_max(xs)) / 2, 6) AS cx, round((list_min(ys) + list_max(ys)) / 2, 6) AS cy,
    round(list_max(xs) - list_min(xs), 6) AS w, round(list_max(ys) - list_min(ys), 6) AS h FROM (
    SELECT vec_id, list_transform(range(1, 64, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS xs, list_transform(range(2, 65, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS ys FROM embeddings)"""
)
def polygon_bbox(spark: SparkSession, d: str) -> DataFrame:
    box = labels.bbox(F.transform("embedding", lambda x: x.cast("double")))
    boxes = table(spark, d, "embeddings").select("vec_id", box.alias("b"))
    return boxes.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")])


def _splits(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("label") <= 5, "train").when(F.col("label") <= 7, "valid").otherwise("test")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), split.alias("split"), F.col("embedding").alias("v"))


SPLITS = "s AS (SELECT vec_id AS id, CASE WHEN label <= 5 THEN 'train' WHEN label <= 7 THEN 'valid' ELSE 'test' END AS split, CASE WHEN label <= 5 THEN 1 WHEN label <= 7 THEN 2 ELSE 3 END AS r, embedding AS v FROM embeddings)"
PAIRS = (
    SPLITS
    + """, pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.split AS a_split, b.split AS b_split FROM s a JOIN s b ON a.split <> b.split AND (a.r, a.id) < (b.r, b.id)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / 64 < 0.11)"""
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(_splits(spark, d), 0.11)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def near_dupes(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).drop("diff")


@query(f"WITH {PAIRS} SELECT b_id AS id, b_split AS from_split, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def dupe_moves(spark: SparkSession, d: str) -> DataFrame:
    return dedup.moves(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT DISTINCT * FROM (SELECT a_id AS id, a_split AS from_split FROM pairs UNION ALL SELECT b_id, b_split FROM pairs) WHERE from_split <> 'train'")
def dupe_settled(spark: SparkSession, d: str) -> DataFrame:
    return dedup.settled(_pairs(spark, d))


@query(f"WITH {SPLITS} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.split_counts(_splits(spark, d))


LABEL_TEXT = "CASE WHEN toxic = 1 THEN '' WHEN doc_id % 3 = 0 THEN '0 0.5 0.5 0.25 0.25' ELSE '0 0.25 0.25 0.75 0.25 0.75 0.5 0.25 0.5' END"


def _label_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.expr(LABEL_TEXT).alias("text"))


@query(f"SELECT doc_id, length(text) * 1.0 / 20000 AS flatness FROM documents WHERE length(text) * 1.0 / 20000 > 0.1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE ({LABEL_TEXT}) <> '')")
def zero_box_flat(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "documents").select("doc_id", (F.length("text") * 1.0 / 20000).alias("flatness"))
    images = images.select("doc_id", F.col("flatness").cast("double").alias("flatness"))
    return labels.graphics_to_drop(labels.zero_box(images, _label_files(spark, d), ["doc_id"]), 0.1)


@query(f"SELECT doc_id, 1 AS n_polygons, '0 0.500000 0.375000 0.500000 0.250000' || chr(10) AS text FROM labels WHERE ({LABEL_TEXT}) LIKE '% 0.75 %'")
def repair_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.repair_labels(_label_files(spark, d))


# Remote planning ----------------------------------------------------------------


def _images(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    classes = F.map_from_entries(F.collect_list(F.struct("role", "n")))
    images = per.groupBy("conv_id").agg(F.sum("n").alias("count"), classes.alias("classes"))
    return images.select(
        F.col("conv_id").alias("id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("conv_id") % 3 == 1, "train").otherwise("valid")).alias("split"),
        F.struct("count", "classes").alias("annotations"),
    )


@query("SELECT role AS name, count(*) AS n FROM conversations GROUP BY role")
def tag_histograms(spark: SparkSession, d: str) -> DataFrame:
    return remote.class_histogram(_images(spark, d))


@query("SELECT CASE conv_id % 3 WHEN 0 THEN '?' WHEN 1 THEN 'train' ELSE 'valid' END AS split, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1")
def split_histogram(spark: SparkSession, d: str) -> DataFrame:
    return remote.split_histogram(_images(spark, d))


@query(
    """SELECT count(*) FILTER (r = 0) AS done, count(*) FILTER (r > 0) AS raw, count(*) FILTER (r > 0 AND r < n) AS mixed
    FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS r FROM conversations GROUP BY conv_id)"""
)
def boxes_vs_polygons(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "polygon")
    points = F.when(F.col("role") == "user", F.array(F.col("turn")))
    boxes = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(kind.alias("type"), points.alias("points"))).alias("boxes"))
    return remote.polygon_progress(boxes)


@query(
    """SELECT doc_id AS id, 'add' AS op FROM documents WHERE n_chars > 5000 AND doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'remove' FROM documents WHERE n_chars < 500 AND doc_id IN (SELECT doc_id FROM labels)"""
)
def tag_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    tagged = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return remote.tag_actions(docs.where("n_chars > 5000"), tagged, docs.where("n_chars < 500"))


@query(
    """SELECT name, path, prio FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS name, printf('%06d', page_id) AS path,
    CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END AS prio, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]*)', 1)
    ORDER BY CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END, page_id) AS n FROM pages) WHERE n = 1"""
)
def upload_jobs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("name"), F.format_string("%06d", "page_id").alias("path"),
        F.startswith("url", F.lit("https:")).alias("safe"),
    )
    jobs = remote.upload_jobs([pages.where("safe").drop("safe"), pages.where("not safe").drop("safe")])
    return jobs.select("name", "path", "prio")


@query(
    """SELECT split, count(*) AS n FROM (SELECT split, row_number() OVER (PARTITION BY name ORDER BY split, page_id) AS r
    FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS name, page_id,
    CASE WHEN url LIKE 'https:%' THEN 'train' ELSE 'valid' END AS split FROM pages)) WHERE r = 1 GROUP BY split"""
)
def job_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("name"), F.col("page_id").alias("path"),
        F.when(F.startswith("url", F.lit("https:")), "train").otherwise("valid").alias("split"),
    )
    return remote.job_counts(remote.upload_jobs([pages.where("split = 'train'"), pages.where("split = 'valid'")]))


@query("SELECT o_orderkey AS frame FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return remote.preview(table(spark, d, "orders").select(F.col("o_orderkey").alias("frame")), "frame")


@query("SELECT count(*) AS videos, CAST(sum(n) AS BIGINT) AS frames FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def extraction_total(spark: SparkSession, d: str) -> DataFrame:
    videos = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return stats.extraction_total(videos, "n")


@query("SELECT event_id FROM events")
def paged_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")

    def sweep(i: int) -> DataFrame:
        page = F.floor(F.col("event_id") / 100)
        seen = F.lit(True) if i >= 2 else (page + i) % 3 != 0
        return events.where(seen).select("event_id", F.lit(i).alias("sweep"), page.alias("offset"))

    return remote.sweep_until_quiet(sweep, "event_id", ["sweep", "offset"]).select("event_id")


@query(
    "SELECT n_nationkey, n_name, CASE n_nationkey WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS \"offset\", CAST(n_regionkey + 1 - CASE n_nationkey WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS BIGINT) AS idx FROM nation"
)
def offsets_default(spark: SparkSession, d: str) -> DataFrame:
    file = spark.createDataFrame([(1, 1), (2, 2)], "n_nationkey int, offset int")
    flags = spark.createDataFrame([(1, 9), (3, 3)], "n_nationkey int, offset int")
    offsets = remote.overridden(file, flags, "n_nationkey", "offset")
    rows = remote.with_offset(table(spark, d, "nation"), offsets, "n_nationkey")
    idx = N.dataset_index(F.col("n_regionkey") + 1, "offset").cast("bigint")
    return rows.select("n_nationkey", "n_name", "offset", idx.alias("idx"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'P') AS failed, 0 AS exit_code FROM orders")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_summary(table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("ok")))


# Detections and events -----------------------------------------------------------

KINDS = ["click", "error", "purchase", "signup", "view"]


def _dets(spark: SparkSession, d: str) -> DataFrame:
    cls = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("int") - 1
    points = F.transform(F.array(F.lit(0.1), F.lit(0.6)), lambda v: F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), v.alias("v")))
    det = F.struct("event_id", F.col("value").alias("conf"), cls.alias("cls"), points.alias("keypoints"))
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list(det).alias("dets"))


@query(
    "SELECT user_id, count(*) FILTER (value >= 20 AND event_type IN ('click', 'purchase')) AS n_kept, count(*) FILTER (value >= 20 AND event_type IN ('click', 'purchase')) AS n_points, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (value >= 20 AND event_type IN ('click', 'purchase')), '') AS ids FROM events GROUP BY user_id"
)
def det_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = _dets(spark, d).select("user_id", detections.visible_keypoints(detections.filtered("dets", 20.0, [0, 2])).alias("k"))
    return kept.select(
        "user_id", F.size("k").cast("bigint").alias("n_kept"),
        F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["keypoints"])).alias("n_points"),
        F.array_join(F.transform(F.array_sort(F.transform("k", lambda x: x["event_id"])), lambda i: i.cast("string")), ",").alias("ids"),
    )


@query("SELECT event_type AS cls, count(DISTINCT user_id) AS tracks FROM events GROUP BY event_type")
def unique_tracks(spark: SparkSession, d: str) -> DataFrame:
    return detections.unique_tracks(table(spark, d, "events").select(F.col("event_type").alias("cls"), F.col("user_id").alias("track_id")))


@query(
    """SELECT user_id, CAST(sum(n) AS BIGINT) AS n_det, round(max(m), 6) AS max_conf, string_agg(name || ':' || n, ' ' ORDER BY cls) AS classes FROM (
    SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cls,
    CASE event_type WHEN 'view' THEN '4' ELSE event_type END AS name, count(*) AS n, max(value) AS m FROM events GROUP BY ALL) GROUP BY user_id"""
)
def overlay_stats(spark: SparkSession, d: str) -> DataFrame:
    cls = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("int") - 1
    names = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS[:4]) for x in (i, k)])
    each = table(spark, d, "events").select("user_id", cls.alias("cls"), F.col("value").alias("conf"))
    each = each.withColumn("name", detections.class_name(names, F.col("cls")))
    return detections.overlay_stats(each, ["user_id"]).withColumn("max_conf", F.round("max_conf", 6))


@query(
    f"""WITH {USER_EVENTS}, e AS (SELECT video, idx - 2 AS start, idx + 2 AS "end", 'purchase' AS label,
      row_number() OVER (PARTITION BY video ORDER BY idx - 2, idx + 2) AS n, count(*) OVER (PARTITION BY video) AS of FROM ue WHERE event_type = 'purchase')
    SELECT event_id, e.start, e."end", label, CAST(n AS INTEGER) AS n, of FROM ue JOIN e ON ue.video = e.video AND ue.idx BETWEEN e.start AND e."end"
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n) = 1"""
)
def active_event(spark: SparkSession, d: str) -> DataFrame:
    events = user_events(spark, d)
    held = events.where("event_type = 'purchase'").select(
        "video", (F.col("idx") - 2).alias("start"), (F.col("idx") + 2).alias("end"), F.lit("purchase").alias("label")
    )
    found = detections.active_event(events.select("event_id", "video", "idx"), held, cell=16)
    return found.select("event_id", "start", "end", "label", "n", "of")


def _next_sql(backward: bool) -> str:
    pick, cmp = ("max", "<") if backward else ("min", ">")
    return f"""WITH {USER_EVENTS}, s AS (SELECT video, idx AS start FROM ue WHERE event_type = 'error')
    SELECT event_id, coalesce({pick}(s.start) FILTER (s.start {cmp} ue.idx), {pick}(s.start)) AS target,
      count(s.start) > 0 AND count(s.start) FILTER (s.start {cmp} ue.idx) = 0 AS wrapped
    FROM ue LEFT JOIN s ON ue.video = s.video GROUP BY event_id"""


def _next(spark: SparkSession, d: str, backward: bool) -> DataFrame:
    events = user_events(spark, d)
    starts = events.where("event_type = 'error'").select("video", F.col("idx").alias("start"))
    found = detections.next_start(events.select("event_id", "video", "idx"), starts, backward=backward)
    return found.select("event_id", "target", "wrapped")


@query(_next_sql(False))
def next_event_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d, False)


@query(_next_sql(True))
def previous_event_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d, True)


def _scan_sql(backward: bool) -> str:
    walk = (
        "CASE WHEN x - 3 >= 0 THEN range(x - 3, -1, -3) ELSE [] END || range(total - 1, -1, -3)"
        if backward
        else "range(x + 3, total, 3) || range(0, total, 3)"
    )
    return f"""WITH {USER_EVENTS}, t AS (SELECT video, count(*) AS total FROM ue GROUP BY video),
    p AS (SELECT event_id, ue.video, total, idx AS x FROM ue JOIN t ON ue.video = t.video WHERE event_type = 'signup'),
    w AS (SELECT event_id, video, list_slice({walk}, 1, CAST(ceil(total / 3.0) AS BIGINT)) AS c FROM p),
    u AS (SELECT event_id, video, unnest(c) AS f, unnest(range(1, len(c) + 1)) AS pos FROM w),
    h AS (SELECT u.event_id, arg_min(u.f, u.pos) AS target FROM u JOIN ue ON u.video = ue.video AND u.f = ue.idx AND ue.event_type = 'purchase' GROUP BY u.event_id)
    SELECT p.event_id, h.target FROM p LEFT JOIN h ON p.event_id = h.event_id"""


def _scan(spark: SparkSession, d: str, backward: bool) -> DataFrame:
    events = user_events(spark, d)
    totals = events.groupBy("video").agg(F.count("*").alias("total"))
    probes = events.where("event_type = 'signup'").join(totals, "video").select("event_id", "video", "idx", "total")
    frames = events.where("event_type = 'purchase'").select("video", F.col("idx").alias("frame"))
    return detections.next_detection(probes, frames, stride=3, backward=backward).select("event_id", "target")


@query(_scan_sql(False))
def stride_scan(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, False)


@query(_scan_sql(True))
def stride_scan_back(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, True)


@query(
    """SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1], 6) AS p90,
    round(min(value), 6) AS least, round(1000 / nullif(median(value), 0), 6) AS per_second FROM events WHERE value > 0 GROUP BY event_type"""
)
def bench_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.latency_summary(table(spark, d, "events").where("value > 0"), "value", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "least", "per_second")])


@query(
    """SELECT event_id, 0 AS frame, 1 AS n_dets, greatest(0, least(640, CAST(event_id % 1000 - 200 AS INTEGER))) AS x1, 480 AS y2, CAST(user_id % 5 AS INTEGER) AS cls,
    CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS track_id, 1 AS n_points, event_type AS name FROM events"""
)
def parse_detections(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(
        F.lit('{"names":{"0":"'), F.col("event_type"), F.lit('"},"frames":[[['), (F.col("event_id") % 1000 - 200).cast("string"),
        F.lit(",-9,99999999999999999999,1e19,0.5,"), (F.col("user_id") % 5).cast("string"), F.lit(","),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("null"), F.lit(",[[-4,1e20,0.25]]]]]}"),
    )
    frames = detections.parse_detections(table(spark, d, "events").select("event_id", text.alias("text")), 640, 480)
    det = F.col("dets")[0]
    return frames.select(
        "event_id", "frame", F.size("dets").alias("n_dets"), det["x1"].alias("x1"), det["y2"].alias("y2"), det["cls"].alias("cls"),
        det["track_id"].alias("track_id"), F.size(det["keypoints"]).alias("n_points"), F.element_at("names", F.lit(0)).alias("name"),
    )


@query(
    """SELECT r_regionkey, e.s AS start, e.t AS "end", e.l AS label, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY e.s, e.t, e.l) AS INTEGER) AS n, 3 AS of
    FROM region, (VALUES (0, 2089, 'hand_up'), (2089, 2089, 'event'), (0, 0, 'event')) e(s, t, l)"""
)
def parse_events(spark: SparkSession, d: str) -> DataFrame:
    text = '[{"start":-5,"end":99999,"label":"hand_up"},{"start":5000,"end":6000},{"start":-50,"end":-10}]'
    return detections.parse_events(table(spark, d, "region").select("r_regionkey", F.lit(text).alias("text")), 2090)
