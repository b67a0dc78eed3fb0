"""Annotation tables derived from the driver's ``events``, in Spark and as DuckDB common tables.

An image is a user, a category an event type, an annotation an event; geometry is
integer arithmetic on the event id, so both engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 1000

#: Label forest (id, name, supercategory); "system" is a heading, not a label.
CATEGORIES = ((1, "view", ""), (2, "click", "view"), (3, "purchase", "click"), (4, "signup", "view"), (5, "error", "system"))


def reference(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        e.alias("ann_id"),
        F.col("user_id").alias("image_id"),
        F.col("event_type").alias("category"),
        ((e * 7919) % 900).alias("x0"),
        ((e * 104729) % 900).alias("y0"),
        (8 + (e * 29) % 93).alias("w"),
        (8 + (e * 17) % 93).alias("h"),
    )


def predicted(spark: SparkSession, d: str) -> DataFrame:
    ref = reference(spark, d)
    i = F.col("ann_id")
    score = (((i * 37) % 100).cast("double") / F.lit(100.0)).alias("score")
    near = ref.where(i % 7 != 0).select("ann_id", "image_id", "category", (F.col("x0") + (i * 13) % 7).alias("x0"), (F.col("y0") + (i * 11) % 5).alias("y0"), "w", "h", score)
    far = ref.where(i % 10 == 3).select((i + 100000000).alias("ann_id"), "image_id", "category", ((F.col("x0") + 450) % 900).alias("x0"), ((F.col("y0") + 300) % 900).alias("y0"), "w", "h", score)
    return near.unionAll(far)


def corners(boxes: DataFrame) -> DataFrame:
    """Boxes by corner (x0, y0, x1, y1) in place of width and height."""
    return boxes.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h")).drop("w", "h")


def rects(boxes: DataFrame) -> DataFrame:
    """L-shaped masks of boxes as two disjoint rectangles: the left half, and the lower part of the right half."""
    half = (F.col("x0") + F.floor(F.col("w") / 2)).cast("long"), (F.col("y0") + F.floor(F.col("h") / 2)).cast("long")
    right, low = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    part = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "w", "h")]
    return boxes.select(*rest, F.explode(F.array(part(F.col("x0"), F.col("y0"), half[0], low), part(half[0], half[1], right, low))).alias("r")).select(*rest, "r.*")


def images(spark: SparkSession, d: str) -> DataFrame:
    """One row per image; sizes vary with the id for tile planning."""
    return (
        spark.read.parquet(f"{d}/events.parquet")
        .select(F.col("user_id").alias("id"))
        .distinct()
        .select("id", F.concat(F.lit("img_"), F.col("id").cast("string"), F.lit(".png")).alias("file_name"), (600 + (F.col("id") * 37) % 900).cast("int").alias("width"), (500 + (F.col("id") * 53) % 700).cast("int").alias("height"))
    )


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, n, s in CATEGORIES], "id int, name string, supercategory string")


def searches(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("image_id"), F.lower("event_type").alias("prompt"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("completed"))


#: The same tables for the oracles; starts a WITH list.
_TABLES = f"""WITH RECURSIVE fx_ref AS (
  SELECT event_id AS ann_id, user_id AS image_id, event_type AS category, (event_id * 7919) % 900 AS x0, (event_id * 104729) % 900 AS y0,
         8 + (event_id * 29) % 93 AS w, 8 + (event_id * 17) % 93 AS h FROM events),
fx_pred AS (
  SELECT ann_id, image_id, category, x0 + (ann_id * 13) % 7 AS x0, y0 + (ann_id * 11) % 5 AS y0, w, h, CAST((ann_id * 37) % 100 AS DOUBLE) / 100.0::DOUBLE AS score
  FROM fx_ref WHERE ann_id % 7 <> 0
  UNION ALL
  SELECT ann_id + 100000000, image_id, category, (x0 + 450) % 900, (y0 + 300) % 900, w, h, CAST((ann_id * 37) % 100 AS DOUBLE) / 100.0::DOUBLE
  FROM fx_ref WHERE ann_id % 10 = 3),
fx_images AS (
  SELECT DISTINCT user_id AS id, concat('img_', user_id, '.png') AS file_name, CAST(600 + (user_id * 37) % 900 AS INT) AS width, CAST(500 + (user_id * 53) % 700 AS INT) AS height FROM events),
fx_categories AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', '{s}')" for i, n, s in CATEGORIES)}) v(id, name, supercategory)),
fx_searches AS (SELECT user_id AS image_id, lower(event_type) AS prompt, event_id AS seq, value > 50 AS completed FROM events),
"""

_BOXES = """fx_pairs AS (
  SELECT p.image_id, p.category, p.ann_id AS pred_id, r.ann_id AS ref_id, p.w * p.h AS pred_area, r.w * r.h AS ref_area,
         (least(p.x0 + p.w, r.x0 + r.w) - greatest(p.x0, r.x0)) * (least(p.y0 + p.h, r.y0 + r.h) - greatest(p.y0, r.y0)) AS inter
  FROM fx_pred p JOIN fx_ref r ON p.image_id = r.image_id AND p.category = r.category
   AND p.x0 < r.x0 + r.w AND r.x0 < p.x0 + p.w AND p.y0 < r.y0 + r.h AND r.y0 < p.y0 + p.h),
"""

_MASKS = """fx_pred_rects AS (
  SELECT image_id, category, ann_id, score, x0, y0, x0 + w // 2 AS x1, y0 + h AS y1 FROM fx_pred UNION ALL SELECT image_id, category, ann_id, score, x0 + w // 2, y0 + h // 2, x0 + w, y0 + h FROM fx_pred),
fx_ref_rects AS (
  SELECT image_id, category, ann_id, x0, y0, x0 + w // 2 AS x1, y0 + h AS y1 FROM fx_ref UNION ALL SELECT image_id, category, ann_id, x0 + w // 2, y0 + h // 2, x0 + w, y0 + h FROM fx_ref),
fx_pairs AS (
  SELECT p.image_id, p.category, p.ann_id AS pred_id, r.ann_id AS ref_id, any_value(pa.area) AS pred_area, any_value(ra.area) AS ref_area,
         sum((least(p.x1, r.x1) - greatest(p.x0, r.x0)) * (least(p.y1, r.y1) - greatest(p.y0, r.y0)))::BIGINT AS inter
  FROM fx_pred_rects p JOIN fx_ref_rects r ON p.image_id = r.image_id AND p.category = r.category AND p.x0 < r.x1 AND r.x0 < p.x1 AND p.y0 < r.y1 AND r.y0 < p.y1
  JOIN (SELECT ann_id, sum((x1 - x0) * (y1 - y0))::BIGINT AS area FROM fx_pred_rects GROUP BY ann_id) pa ON pa.ann_id = p.ann_id
  JOIN (SELECT ann_id, sum((x1 - x0) * (y1 - y0))::BIGINT AS area FROM fx_ref_rects GROUP BY ann_id) ra ON ra.ann_id = r.ann_id
  GROUP BY p.image_id, p.category, p.ann_id, r.ann_id),
"""

_MATCHED = """fx_iou AS (SELECT *, inter::DOUBLE / (pred_area + ref_area - inter) AS iou FROM fx_pairs),
fx_edges AS (SELECT image_id, category, list([{'pred': pred_id, 'ref': ref_id, 'iou': iou}] ORDER BY iou DESC, pred_id DESC, ref_id DESC) AS e FROM fx_iou WHERE iou >= 0.5 GROUP BY image_id, category),
fx_matches AS (
  SELECT image_id, category, unnest(list_reduce(e, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.pred = x[1].pred OR y.ref = x[1].ref)) = 0 THEN a || x ELSE a END), recursive := true)
  FROM fx_edges)
"""

#: All tables with pairs of boxes, or of L-shaped masks.
SQL = _TABLES + _BOXES + _MATCHED
MASK_SQL = _TABLES + _MASKS + _MATCHED
