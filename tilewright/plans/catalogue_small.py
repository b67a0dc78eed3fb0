"""Queries of projections, predicates and scalar rules, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import masks as M
from tilewright.operators import sweep as P
from tilewright.operators import tiling as L
from tilewright.plans import fixtures as X
from tilewright.plans.oracles import _TILES
from tilewright.sources import files as S

FX = X.SQL
BOX = ("x0", "y0", "x1", "y1")


def _boxes(spark, d):
    return X.corners(X.predicted(spark, d))


def _in_tiles(spark, d):
    """Predicted boxes with every tile that they meet (t_x0 …), clipped to it."""
    sized = X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    tiles = L.grid(X.images(spark, d))
    rect = tiles.select("image_id", "tile", "scale", *[F.col(c).alias(f"t_{c}") for c in BOX])
    return L.detect_boxes(_boxes(spark, d), tiles).join(rect, ["image_id", "tile"]).join(sized, "image_id")


def knob_defaults(spark, d):
    return P.knob_table(spark).where(~F.col("name").isin("scales", "offsets"))


def presented_scales(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", G.presented_scale(F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5)).alias("scale"))


def truncated_boxes(spark, d):
    cut = L.truncated("", "t_", F.lit(2), F.col("width"), F.col("height"))
    return _in_tiles(spark, d).select("image_id", "tile", "ann_id", cut.alias("cut"))


def tile_local_boxes(spark, d):
    seen = _in_tiles(spark, d).withColumn("half", F.col("scale") / 2)
    return seen.select("image_id", "tile", "ann_id", *[c.alias(n) for n, c in L.to_local("", "t_", F.col("half")).items()])


def tile_round_trip(spark, d):
    """Boxes moved into their tiles at a quarter of the scale and back."""
    local = _in_tiles(spark, d).withColumn("q", F.col("scale") / 4)
    moved = local.withColumns({f"m_{n}": c for n, c in L.to_local("", "t_", F.col("q")).items()})
    return moved.select("image_id", "tile", "ann_id", *[c.cast("long").alias(n) for n, c in L.to_global("m_", "t_", F.col("q")).items()])


def tile_sizes(spark, d):
    tiles = L.grid(X.images(spark, d), presented=100)
    return tiles.select("image_id", "tile", *L.presented_size("", F.col("scale")))


def prompt_boxes(spark, d):
    boxes = _boxes(spark, d).where("ann_id % 9 = 0").withColumn("positive", F.col("ann_id") % 2 == 0)
    return L.prompts(boxes, L.grid(X.images(spark, d)))


def packed_first_slot(spark, d):
    """Detections on canvases of nine cells of 100 pixels, two slots to a cell, handed to the first slot that holds their centre."""
    boxes = _boxes(spark, d).select("ann_id", F.col("image_id").alias("canvas"), *[(F.col(c) / 3).alias(c) for c in BOX])
    slot = F.explode(F.sequence(F.lit(0), F.lit(17)))
    slots = X.images(spark, d).select(F.col("id").alias("canvas"), slot.alias("slot")).withColumn("cell", F.floor(F.col("slot") / 2))
    slots = slots.select("canvas", "slot", ((F.col("cell") % 3) * 100).alias("cell_x"), (F.floor(F.col("cell") / 3) * 100).alias("cell_y"), F.lit(100).alias("cell_w"), F.lit(100).alias("cell_h"))
    return L.first_slot(boxes, slots)


def centres_inside(spark, d):
    rect = {f"r_{c}": F.lit(v) for c, v in zip(BOX, (200, 150, 600, 500), strict=True)}
    return _boxes(spark, d).withColumns(rect).where(G.centre_inside("", "r_")).select("ann_id")


def members_inside(spark, d):
    rect = {f"r_{c}": F.lit(v) for c, v in zip(BOX, (200, 150, 600, 500), strict=True)}
    return _boxes(spark, d).withColumns(rect).where(G.inside_by("", "r_", F.lit(10))).select("ann_id")


def points_in_reach(spark, d):
    return _boxes(spark, d).where(G.within_reach(F.lit(400), F.lit(300), "", F.col("ann_id") % 50)).select("ann_id")


def cluster_hulls(spark, d):
    boxes = _boxes(spark, d)
    groups = boxes.select("image_id", "ann_id", (F.col("ann_id") % 4).alias("cluster"))
    return P.cluster_hulls(boxes, groups).select("image_id", "shot", *[F.col(f"h{c}").alias(c) for c in BOX], "scale")


def seed_order(spark, d):
    return P.seed_order(_boxes(spark, d).withColumn("score", F.when(F.col("ann_id") % 6 != 0, F.col("score"))))


def sorted_groups(spark, d):
    rows = X.reference(spark, d).withColumn("g", F.col("ann_id") * 7 % 5)
    return P.listed_groups(rows, ["image_id"], "g", "ann_id").select("image_id", "place", F.array_join("members", ",").alias("members"))


def instance_labels(spark, d):
    size = F.concat_ws("x", F.col("w").cast("string"), F.col("h").cast("string"))
    passed = F.concat(F.lit("p"), (F.col("ann_id") % 3 + 1).cast("string"), F.lit(" "), F.format_string("%.2f", "score"))
    return X.predicted(spark, d).select("ann_id", F.concat(F.lit("#"), F.col("ann_id").cast("string")).alias("label"), passed.alias("origin"), size.alias("size"))


def distinct_masks(spark, d):
    return M.distinct_masks(X.reference(spark, d).select(F.concat_ws("x", "w", "h").alias("counts")))


def sample_steps(spark, d):
    return X.images(spark, d).select("id", M.sample_step(F.col("width") * 7, 2016).alias("step"))


def shown_pixels(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", L.shown_pixel(F.col("event_id") % 640, F.lit(640), F.lit(1001)).alias("pixel"))


def half_even(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", G.half_even((F.col("event_id") - 300) / 2).alias("rounded"), G.clamp(F.col("event_id"), F.lit(50), F.lit(400)).alias("clamped"))


def sigmoids(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(G.sigmoid((F.col("event_id") % 41 - 20) / 4), 9).alias("p"))


def content_hashes(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.sha2("c_name", 256).alias("sha256"), F.substring(F.sha1("c_name"), 1, 16).alias("short"))


def empty_tables(spark, d):
    """Column counts of a dataset without rows."""
    return spark.createDataFrame([(k, len(t.columns), t.count()) for k, t in S.empty_dataset(spark).items()], "name string, n_columns int, n_rows int")


_SEEN = _TILES + """,
seen AS (SELECT c.*, p.ann_id, greatest(p.x0, c.x0) AS a0, greatest(p.y0, c.y0) AS b0, least(p.x0 + p.w, c.x1) AS a1, least(p.y0 + p.h, c.y1) AS b1
  FROM fx_pred p JOIN cores c ON c.image_id = p.image_id AND p.x0 < c.x1 AND c.x0 < p.x0 + p.w AND p.y0 < c.y1 AND c.y0 < p.y0 + p.h)
"""
ORACLES = {
    "knob_defaults": """SELECT * FROM (VALUES ('tile', '256'), ('overlap', '0.25'), ('presented', '256'), ('gap', '4.0'), ('max_frac', '0.8'), ('dup_iou', '0.5'), ('dup_ios', '0.8'), ('expand', '1.5'), ('min_tile', '256'), ('band', 'null'),
 ('novel', 'false'), ('retries', '0'), ('step', '0.75'), ('oversize', '4.0'), ('pack', '1'), ('exemplar_frac', '0.25'), ('edge_margin', '0.05')) v(name, value)""",
    "presented_scales": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 <= 1 THEN 1.0 ELSE 1.0 / (event_id % 5)::DOUBLE END::DOUBLE AS scale FROM events",
    "truncated_boxes": FX + _SEEN + "SELECT image_id, tile, ann_id, (a0 < x0 + 2 AND x0 > 0) OR (b0 < y0 + 2 AND y0 > 0) OR (a1 > x1 - 2 AND x1 < width) OR (b1 > y1 - 2 AND y1 < height) AS cut FROM seen",
    "tile_local_boxes": FX + _SEEN + """, s AS (SELECT *, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(x1 - x0, y1 - y0)) / 2 AS k FROM seen)
SELECT image_id, tile, ann_id, (a0 - x0) * k AS x0, (b0 - y0) * k AS y0, (a1 - x0) * k AS x1, (b1 - y0) * k AS y1 FROM s""",
    "tile_round_trip": FX + _SEEN + "SELECT image_id, tile, ann_id, a0 AS x0, b0 AS y0, a1 AS x1, b1 AS y1 FROM seen",
    "tile_sizes": FX + _TILES + """SELECT image_id, tile, greatest(round_even((x1 - x0) * least(1.0::DOUBLE, 100.0::DOUBLE / greatest(x1 - x0, y1 - y0)), 0), 1)::BIGINT AS out_w,
 greatest(round_even((y1 - y0) * least(1.0::DOUBLE, 100.0::DOUBLE / greatest(x1 - x0, y1 - y0)), 0), 1)::BIGINT AS out_h FROM tiles""",
    "prompt_boxes": FX + _TILES + """, s AS (SELECT *, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(x1 - x0, y1 - y0)) AS k FROM tiles)
SELECT t.image_id, t.tile, p.ann_id, p.ann_id % 2 = 0 AS positive, (p.x0 - t.x0) * k AS x0, (p.y0 - t.y0) * k AS y0, (p.x0 + p.w - t.x0) * k AS x1, (p.y0 + p.h - t.y0) * k AS y1
FROM s t JOIN fx_pred p ON p.image_id = t.image_id AND p.ann_id % 9 = 0 AND p.x0 >= t.x0 AND p.y0 >= t.y0 AND p.x0 + p.w <= t.x1 AND p.y0 + p.h <= t.y1""",
    "packed_first_slot": FX + """, c AS (SELECT ann_id, (x0 / 3.0::DOUBLE + (x0 + w) / 3.0::DOUBLE) / 2 AS cx, (y0 / 3.0::DOUBLE + (y0 + h) / 3.0::DOUBLE) / 2 AS cy FROM fx_pred)
SELECT ann_id, (2 * (floor(cy / 100) * 3 + floor(cx / 100)))::INT AS slot FROM c WHERE cx < 300 AND cy < 300""",
    "centres_inside": FX + "SELECT ann_id FROM fx_pred WHERE x0 + w / 2.0::DOUBLE BETWEEN 200 AND 600 AND y0 + h / 2.0::DOUBLE BETWEEN 150 AND 500",
    "members_inside": FX + "SELECT ann_id FROM fx_pred WHERE x0 >= 210 AND y0 >= 160 AND x0 + w <= 590 AND y0 + h <= 490",
    "points_in_reach": FX + "SELECT ann_id FROM fx_pred WHERE greatest(x0 - 400, 400 - x0 - w, y0 - 300, 300 - y0 - h, 0) <= ann_id % 50",
    "cluster_hulls": FX + "SELECT image_id, ann_id % 4 AS shot, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1, median(greatest(w, h))::DOUBLE AS scale FROM fx_pred GROUP BY image_id, ann_id % 4",
    "seed_order": FX + """SELECT image_id, ann_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN ann_id % 6 = 0 THEN 'inf'::DOUBLE ELSE score END DESC, ann_id) - 1 AS by_score,
 row_number() OVER (PARTITION BY image_id ORDER BY w * h, ann_id) - 1 AS by_area FROM fx_pred""",
    "sorted_groups": FX + """, g AS (SELECT image_id, ann_id * 7 % 5 AS g, min(ann_id) AS low, string_agg(ann_id::VARCHAR, ',' ORDER BY ann_id) AS members FROM fx_ref GROUP BY ALL)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY low) - 1 AS place, members FROM g""",
    "instance_labels": FX + "SELECT ann_id, '#' || ann_id AS label, 'p' || (ann_id % 3 + 1) || ' ' || printf('%.2f', score) AS origin, w || 'x' || h AS size FROM fx_pred",
    "distinct_masks": FX + "SELECT sha1(w || 'x' || h) AS key, count(*) AS uses FROM fx_ref GROUP BY w, h",
    "sample_steps": FX + "SELECT id, greatest(ceil(width * 7 / 2016.0::DOUBLE), 1)::BIGINT AS step FROM fx_images",
    "shown_pixels": "SELECT event_id, (event_id % 640) * 1001 // 640 AS pixel FROM events",
    "half_even": "SELECT event_id, round_even((event_id - 300) / 2.0::DOUBLE, 0)::BIGINT AS rounded, greatest(50, least(event_id, 400)) AS clamped FROM events",
    "sigmoids": "SELECT event_id, round(1 / (1 + exp(-(event_id % 41 - 20) / 4.0::DOUBLE)), 9) AS p FROM events",
    "content_hashes": "SELECT c_custkey, sha256(c_name) AS sha256, left(sha1(c_name), 16) AS short FROM customer",
    "empty_tables": "SELECT * FROM (VALUES ('images', 4, 0), ('categories', 3, 0), ('annotations', 8, 0)) v(name, n_columns, n_rows)",
}

QUERIES = {f.__name__: f for f in (
    knob_defaults, presented_scales, truncated_boxes, tile_local_boxes, tile_round_trip, tile_sizes, prompt_boxes, packed_first_slot, centres_inside, members_inside, points_in_reach, cluster_hulls,
    seed_order, sorted_groups, instance_labels, distinct_masks, sample_steps, shown_pixels, half_even, sigmoids, content_hashes, empty_tables,
)}
