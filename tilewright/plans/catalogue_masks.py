"""Queries on masks, snapshots, drawing and the sweep's folds, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import drawing as W
from tilewright.operators import evaluation as E
from tilewright.operators import masks as M
from tilewright.operators import runs as R
from tilewright.operators import snapshots as N
from tilewright.plans import fixtures as X
from tilewright.plans.oracles import _OUTCOMES, _r

FX = X.MASK_SQL
BOX = ("x0", "y0", "x1", "y1")


def _pred(spark, d):
    return X.rects(X.predicted(spark, d))


def _ref(spark, d):
    return X.rects(X.reference(spark, d))


def mask_pair_iou(spark, d):
    return M.mask_pairs(_pred(spark, d), _ref(spark, d)).select("image_id", "category", "pred_id", "ref_id", "inter", "iou")


def eval_mask_outcomes(spark, d):
    return E.mask_outcomes(_pred(spark, d), _ref(spark, d)).select("image_id", "category", "kind", F.col("pred").alias("pred_id"), F.col("ref").alias("ref_id"), "iou", F.col("area").cast("long").alias("area"))


def eval_mask_report(spark, d):
    return E.report(E.mask_outcomes(_pred(spark, d), _ref(spark, d)), X.images(spark, d))


def eval_mask_splits(spark, d):
    return E.splits_and_merges(M.mask_pairs(_pred(spark, d), _ref(spark, d)), 0.4)


def eval_rows(spark, d):
    found = E.listed(E.mask_outcomes(_pred(spark, d), _ref(spark, d)))
    return found.where("image_id % 5 = 1").select("image_id", "category", "kind", F.col("pred").alias("pred_id"), F.col("ref").alias("ref_id"), F.col("area").cast("long").alias("area"), "iou")


def eval_index(spark, d):
    ids = spark.createDataFrame([(i, n) for i, n, _ in X.CATEGORIES if n != "error"], "id int, name string")
    images = X.images(spark, d).where("id % 9 <> 0").withColumn("file_name", F.concat(F.lit("a\\b/"), "file_name"))
    numbers = spark.createDataFrame([(i, n) for i, n, _ in X.CATEGORIES], "category_id int, category string")
    rows = X.reference(spark, d).join(numbers, "category").withColumn("counts", F.when(F.col("ann_id") % 6 != 0, "x"))
    return M.index_instances(rows.drop("category"), images, ids).groupBy("file_name", "category").agg(F.count("*").alias("n"))


def eval_spine(spark, d):
    files = X.images(spark, d).select(F.col("id").alias("image_id"), "file_name")
    named = lambda side: side.join(files, "image_id").select("file_name", "category")
    return M.scored_spine(files, X.categories(spark).select(F.col("name").alias("category")), named(X.reference(spark, d)), named(X.predicted(spark, d).where("category <> 'error' AND image_id % 3 <> 0")))


def mask_shapes(spark, d):
    return M.mask_shape(_pred(spark, d), ["image_id", "ann_id"])


def mask_annotations(spark, d):
    shapes = M.mask_shape(_pred(spark, d), ["image_id", "ann_id", "score"])
    return M.to_annotation(shapes).select("image_id", "ann_id", "score", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",").alias("bbox"), "area", "iscrowd")


def mask_wire(spark, d):
    shapes = M.mask_shape(_pred(spark, d), ["image_id", "ann_id", "score"])
    return M.wire(shapes.withColumn("cx", F.when(F.col("ann_id") % 3 != 0, F.col("cx"))).withColumn("cy", F.when(F.col("ann_id") % 3 != 0, F.col("cy"))))


def mask_rectangles(spark, d):
    """Pixel columns of the L shapes joined to rectangles again."""
    runs = M.column_runs(_ref(spark, d), ["ann_id"], 2000)
    return M.rectangles(runs, ["ann_id"], 2000).select("ann_id", *BOX)


def _windowed(rects):
    return rects.withColumns({"w_x0": F.lit(200), "w_y0": F.lit(150), "w_x1": F.lit(700), "w_y1": F.lit(600)})


def mask_window(spark, d):
    return M.mask_area(M.inside_window(_windowed(_ref(spark, d))), ["ann_id"])


def mask_splice(spark, d):
    """Every reference mask with its window replaced by a 40 by 30 patch in the window's corner."""
    ref = _ref(spark, d)
    ids = ref.select("ann_id").distinct().where("ann_id % 2 = 0")
    patch = _windowed(ids).withColumns({"x0": F.lit(0).cast("long"), "y0": F.lit(0).cast("long"), "x1": F.lit(40).cast("long"), "y1": F.lit(30).cast("long")})
    return M.mask_area(M.replace_window(ref.select("ann_id", *BOX), patch, ["ann_id"]), ["ann_id"])


def mask_upscale(spark, d):
    """Masks of the 1000 by 1000 frame shown on 1777 by 640 pixels."""
    wide = M.upscaled(_ref(spark, d), F.lit(1001), F.lit(1777), "x")
    return M.mask_area(M.upscaled(wide, F.lit(1001), F.lit(640), "y"), ["ann_id"])


def mask_sample(spark, d):
    return M.sampled(_ref(spark, d), ["ann_id"], 16).groupBy("ann_id").agg(F.count("*").alias("points"))


def mask_covered(spark, d):
    ref = _ref(spark, d)
    return M.covered_share(ref, ref, "ann_id", ["image_id"])


def mask_union_shapes(spark, d):
    return M.mask_area(M.union_rects(_pred(spark, d), ["image_id", "category"]), ["image_id", "category"])


def export_masks(spark, d):
    return M.export_masks(X.images(spark, d), _ref(spark, d), ["signup"])


def export_forced(spark, d):
    out = M.export_masks(X.images(spark, d), _ref(spark, d).where("image_id % 4 = 0"), ["click", "view"], force=True)
    return out.agg(F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("skipped"), F.count_if((F.col("area") == 0) & F.col("written")).alias("blank"))


def integer_rects(spark, d):
    boxes = X.predicted(spark, d).select("ann_id", *[(F.col(c) / 3).alias(c) for c in ("x0", "y0")], ((F.col("x0") + F.col("w") * (F.col("ann_id") % 4)) / 3).alias("x1"), ((F.col("y0") + F.col("h")) / 3).alias("y1"))
    return boxes.select("ann_id", *M.integer_rect())


def mask_keys(spark, d):
    return X.reference(spark, d).select("ann_id", M.mask_key(F.concat_ws(",", "x0", "y0", "w", "h")).alias("key"))


def snapshot_cells(spark, d):
    return N.snapshots(_ref(spark, d), ["image_id", "ann_id"]).groupBy("ann_id").agg(F.count("*").alias("cells"), F.max("gw").cast("int").alias("gw"), F.max("gh").cast("int").alias("gh"))


def snapshot_frontier(spark, d):
    return N.outlines(_ref(spark, d), ["image_id", "ann_id"]).groupBy("ann_id").agg(F.count("*").alias("cells"))


def _small(spark, d):
    """Masks of a few images, shrunk to a side of at most 25 pixels, so that each is its own grid."""
    boxes = X.reference(spark, d).where("image_id < 40").withColumn("w", 4 + F.col("w") % 22).withColumn("h", 4 + F.col("h") % 22)
    return X.rects(boxes.withColumn("x0", F.col("x0") % 150).withColumn("y0", F.col("y0") % 150))


def mask_distance_pairs(spark, d):
    return N.near_masks(N.snapshots(_small(spark, d), ["image_id", "ann_id"]), 4)


def mask_relations(spark, d):
    masks = _small(spark, d)
    shared = N.shared_area(N.snapshots(masks, ["image_id", "ann_id"]))
    return N.mask_relation(shared, M.mask_area(masks, ["image_id", "ann_id"]), dup_iou=0.3, dup_ios=0.5)


def merged_blobs(spark, d):
    masks = _small(spark, d)
    cells = N.snapshots(masks, ["image_id", "ann_id"])
    shared = N.shared_area(cells)
    return N.merged_blobs(shared.where("cover > 0").select("image_id", "a", "b"), N.near_masks(cells, 4))


def draw_masks(spark, d):
    """Areas of a few images' union masks after painting a rectangle, erasing another and taking back a third."""
    runs = R.union_runs(R.box_runs(X.corners(X.reference(spark, d)).where("image_id < 12"), ["image_id"], X.FRAME), ["image_id"], X.FRAME)
    masks = R.encode_runs(runs, "image_id", X.FRAME, X.FRAME)
    text = (
        '[{"kind": "polygon", "points": [[100, 100], [300, 100], [300, 250], [100, 250]]}, {"kind": "polygon", "erase": true, "points": [[200, 200], [400, 200], [400, 600], [200, 600]]},'
        ' {"kind": "polygon", "points": [[0, 0], [900, 0], [900, 900]]}, {"kind": "undo"}]'
    )
    return W.draw_masks(masks, masks.select("image_id", F.lit(text).alias("ops")), "image_id", X.FRAME, X.FRAME).select("image_id", "area", "erased")


_AREA = "sum((x1 - x0) * (y1 - y0))"
_COLS = """,
cols AS (SELECT {keys}, x, y0 AS a, max(y1) AS b FROM (SELECT *, unnest(range(x0, x1)) AS x FROM {table}) GROUP BY {keys}, x, y0),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY {keys}, x ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM cols),
islands AS (SELECT *, sum(new) OVER (PARTITION BY {keys}, x ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT {keys}, x, min(a) AS a, max(b) AS b FROM islands GROUP BY {keys}, x, k)
"""
_FOUND = _OUTCOMES.replace("r.w * r.h AS area", "ra.area").replace("FROM fx_ref r LEFT JOIN", "FROM fx_ref r JOIN (SELECT ann_id, " + _AREA + "::BIGINT AS area FROM fx_ref_rects GROUP BY ann_id) ra ON ra.ann_id = r.ann_id LEFT JOIN").replace(
    "p.w * p.h FROM fx_pred p", "pa.area FROM fx_pred p JOIN (SELECT ann_id, " + _AREA + "::BIGINT AS area FROM fx_pred_rects GROUP BY ann_id) pa ON pa.ann_id = p.ann_id"
)
_SMALL = """,
sm AS (SELECT ann_id, image_id, x0 % 150 AS x0, y0 % 150 AS y0, 4 + w % 22 AS w, 4 + h % 22 AS h FROM fx_ref WHERE image_id < 40),
sr AS (SELECT ann_id, image_id, x0, y0, x0 + w // 2 AS x1, y0 + h AS y1 FROM sm UNION ALL SELECT ann_id, image_id, x0 + w // 2, y0 + h // 2, x0 + w, y0 + h FROM sm),
sz AS (SELECT image_id, ann_id, sum((x1 - x0) * (y1 - y0))::BIGINT AS area FROM sr GROUP BY ALL),
gaps AS (SELECT a.image_id, a.ann_id AS a, b.ann_id AS b, min(greatest(0, b.x0 - a.x1, a.x0 - b.x1, b.y0 - a.y1, a.y0 - b.y1)) AS gap,
         sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))::BIGINT AS hits
  FROM sr a JOIN sr b ON a.image_id = b.image_id AND a.ann_id <> b.ann_id GROUP BY ALL)
"""

ORACLES = {
    "mask_pair_iou": FX + "SELECT image_id, category, pred_id, ref_id, inter, iou FROM fx_iou",
    "eval_mask_outcomes": FX + _FOUND + "SELECT image_id, category, kind, pred AS pred_id, ref AS ref_id, iou, area FROM fx_found",
    "eval_mask_report": FX + _FOUND + f""",
sums AS (
  SELECT i.file_name, f.category, grouping(i.file_name, f.category)::BIGINT AS level, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn,
         coalesce(sum(round_even(iou * 1000000, 0)::BIGINT), 0)::DOUBLE / 1e6::DOUBLE AS s
  FROM fx_found f JOIN fx_images i ON i.id = f.image_id GROUP BY GROUPING SETS ((i.file_name, f.category), (f.category), ()))
SELECT file_name, category, level, tp, fp, fn, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('(2 * tp)', '2 * tp + fp + fn')} AS f1,
       {_r('s', 'tp')} AS sq, {_r('(2 * tp)', '2 * tp + fp + fn')} AS rq, {_r('s', 'tp')} * {_r('(2 * tp)', '2 * tp + fp + fn')} AS pq FROM sums""",
    "eval_mask_splits": FX + """,
splits AS (SELECT category, count(*) AS n FROM (SELECT category, ref_id FROM fx_pairs WHERE inter >= 0.4::DOUBLE * pred_area GROUP BY category, ref_id HAVING count(*) >= 2) GROUP BY category),
merges AS (SELECT category, count(*) AS n FROM (SELECT category, pred_id FROM fx_pairs WHERE inter >= 0.4::DOUBLE * ref_area GROUP BY category, pred_id HAVING count(*) >= 2) GROUP BY category)
SELECT c.category, coalesce(s.n, 0) AS false_splits, coalesce(m.n, 0) AS false_merges FROM (SELECT DISTINCT category FROM fx_pairs) c LEFT JOIN splits s USING (category) LEFT JOIN merges m USING (category)""",
    "eval_rows": FX + _FOUND + "SELECT image_id, category, kind, pred AS pred_id, ref AS ref_id, area, round_even(iou * 10000, 0) / 10000.0::DOUBLE AS iou FROM fx_found WHERE image_id % 5 = 1",
    "eval_index": FX + """SELECT replace('a\\b/' || i.file_name, '\\', '/') AS file_name, r.category, count(*) AS n FROM fx_ref r JOIN fx_images i ON i.id = r.image_id
 WHERE i.id % 9 <> 0 AND r.category <> 'error' AND r.ann_id % 6 <> 0 GROUP BY ALL""",
    "eval_spine": FX + """SELECT i.file_name, c.name AS category, (SELECT count(*) FROM fx_ref r WHERE r.image_id = i.id AND r.category = c.name) AS n_ref,
 (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.id AND p.category = c.name AND i.id % 3 <> 0) AS n_pred FROM fx_images i CROSS JOIN fx_categories c WHERE c.name <> 'error'""",
    "mask_shapes": FX + f"""SELECT image_id, ann_id, {_AREA}::BIGINT AS area, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
 sum((x0 + x1) * (x1 - x0) * (y1 - y0))::DOUBLE / (2 * {_AREA})::DOUBLE AS cx, sum((y0 + y1) * (x1 - x0) * (y1 - y0))::DOUBLE / (2 * {_AREA})::DOUBLE AS cy FROM fx_pred_rects GROUP BY image_id, ann_id""",
    "mask_annotations": FX + "SELECT image_id, ann_id, score, concat_ws(',', x0, y0, w, h) AS bbox, ((w // 2) * h + (w - w // 2) * (h - h // 2))::DOUBLE AS area, 0 AS iscrowd FROM fx_pred",
    "mask_wire": FX + f""",
s AS (SELECT image_id, ann_id, any_value(score) AS score, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
 sum((x0 + x1) * (x1 - x0) * (y1 - y0))::DOUBLE / (2 * {_AREA})::DOUBLE AS cx, sum((y0 + y1) * (x1 - x0) * (y1 - y0))::DOUBLE / (2 * {_AREA})::DOUBLE AS cy FROM fx_pred_rects GROUP BY image_id, ann_id)
SELECT image_id, ann_id, round_even(score * 10000, 0) / 10000.0::DOUBLE AS score, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1,
 round_even(100 * CASE WHEN ann_id % 3 <> 0 THEN cx ELSE (x0 + x1) / 2.0::DOUBLE END, 0) / 100.0::DOUBLE AS cx, round_even(100 * CASE WHEN ann_id % 3 <> 0 THEN cy ELSE (y0 + y1) / 2.0::DOUBLE END, 0) / 100.0::DOUBLE AS cy FROM s""",
    "mask_rectangles": FX + "SELECT ann_id, x0, y0, x1, y1 FROM fx_ref_rects",
    "mask_window": FX + f"""SELECT ann_id, {_AREA}::BIGINT AS area FROM (SELECT ann_id, greatest(x0, 200) AS x0, greatest(y0, 150) AS y0, least(x1, 700) AS x1, least(y1, 600) AS y1 FROM fx_ref_rects)
 WHERE x0 < x1 AND y0 < y1 GROUP BY ann_id""",
    "mask_splice": FX + """SELECT ann_id, area FROM (SELECT ann_id, (sum((x1 - x0) * (y1 - y0)) - CASE WHEN ann_id % 2 = 0 THEN sum(greatest(0, least(x1, 700) - greatest(x0, 200)) * greatest(0, least(y1, 600) - greatest(y0, 150))) - 1200 ELSE 0 END)::BIGINT AS area
 FROM fx_ref_rects GROUP BY ann_id) WHERE area > 0""",
    "mask_upscale": FX + """,
xs AS (SELECT i * 1001 // 1777 AS s, count(*) AS n FROM (SELECT unnest(range(0, 1777)) AS i) GROUP BY 1), ys AS (SELECT i * 1001 // 640 AS s, count(*) AS n FROM (SELECT unnest(range(0, 640)) AS i) GROUP BY 1),
cx AS (SELECT s, sum(n) OVER (ORDER BY s) AS c FROM (SELECT v.s, coalesce(xs.n, 0) AS n FROM (SELECT unnest(range(0, 1101)) AS s) v LEFT JOIN xs USING (s))),
cy AS (SELECT s, sum(n) OVER (ORDER BY s) AS c FROM (SELECT v.s, coalesce(ys.n, 0) AS n FROM (SELECT unnest(range(0, 1101)) AS s) v LEFT JOIN ys USING (s)))
SELECT ann_id, area FROM (SELECT ann_id, sum((b.c - coalesce(a.c, 0)) * (q.c - coalesce(p.c, 0)))::BIGINT AS area FROM fx_ref_rects r JOIN cx b ON b.s = r.x1 - 1 LEFT JOIN cx a ON a.s = r.x0 - 1
 JOIN cy q ON q.s = r.y1 - 1 LEFT JOIN cy p ON p.s = r.y0 - 1 GROUP BY ann_id) WHERE area > 0""",
    "mask_sample": FX + """SELECT ann_id, points FROM (SELECT ann_id, sum(((x1 + 15) // 16 - (x0 + 15) // 16) * ((y1 + 15) // 16 - (y0 + 15) // 16))::BIGINT AS points FROM fx_ref_rects GROUP BY ann_id) WHERE points > 0""",
    "mask_covered": FX + """,
clip AS (SELECT a.ann_id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM fx_ref_rects a JOIN fx_ref_rects b ON a.image_id = b.image_id AND a.ann_id <> b.ann_id
 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""" + _COLS.format(keys="ann_id", table="clip") + """
SELECT r.image_id, r.ann_id, coalesce(any_value(c.n), 0)::DOUBLE / sum((x1 - x0) * (y1 - y0))::DOUBLE AS share FROM fx_ref_rects r LEFT JOIN (SELECT ann_id, sum(b - a) AS n FROM spans GROUP BY ann_id) c USING (ann_id) GROUP BY r.image_id, r.ann_id""",
    "mask_union_shapes": FX + _COLS.format(keys="image_id, category", table="fx_pred_rects") + "SELECT image_id, category, sum(b - a)::BIGINT AS area FROM spans GROUP BY image_id, category",
    "export_masks": FX + ", one AS (SELECT * FROM fx_ref_rects WHERE category = 'signup')" + _COLS.format(keys="image_id", table="one") + """
SELECT i.file_name, replace(i.file_name, '.png', '_mask.tiff') AS target, coalesce(a.n, 0)::BIGINT AS area, a.n IS NOT NULL AS written FROM fx_images i LEFT JOIN (SELECT image_id, sum(b - a) AS n FROM spans GROUP BY image_id) a ON a.image_id = i.id""",
    "export_forced": FX + """SELECT count(*) AS written, 0::BIGINT AS skipped, count(*) FILTER (NOT EXISTS (SELECT 1 FROM fx_ref r WHERE r.image_id = i.id AND i.id % 4 = 0 AND r.category IN ('click', 'view'))) AS blank FROM fx_images i""",
    "integer_rects": FX + """SELECT ann_id, CASE WHEN ann_id % 4 > 0 THEN floor(x0 / 3.0::DOUBLE)::BIGINT ELSE 0 END AS x0, CASE WHEN ann_id % 4 > 0 THEN floor(y0 / 3.0::DOUBLE)::BIGINT ELSE 0 END AS y0,
 CASE WHEN ann_id % 4 > 0 THEN ceil((x0 + w * (ann_id % 4)) / 3.0::DOUBLE)::BIGINT ELSE 1 END AS x1, CASE WHEN ann_id % 4 > 0 THEN ceil((y0 + h) / 3.0::DOUBLE)::BIGINT ELSE 1 END AS y1 FROM fx_pred""",
    "mask_keys": FX + "SELECT ann_id, sha1(concat_ws(',', x0, y0, w, h)) AS key FROM fx_ref",
    "snapshot_cells": FX + """,
px AS (SELECT r.ann_id, b.x0 AS ox, b.y0 AS oy, b.w, b.h, least(b.w, 32) AS gw, least(b.h, 32) AS gh, r.x0, r.y0, r.x1, r.y1 FROM fx_ref_rects r JOIN fx_ref b USING (ann_id)),
cx AS (SELECT *, unnest(range((x0 - ox) * gw // w, (x1 - 1 - ox) * gw // w + 1)) AS gx FROM px), cells AS (SELECT DISTINCT ann_id, gw, gh, gx, unnest(range((y0 - oy) * gh // h, (y1 - 1 - oy) * gh // h + 1)) AS gy FROM cx)
SELECT ann_id, count(*) AS cells, max(gw)::INT AS gw, max(gh)::INT AS gh FROM cells GROUP BY ann_id""",
    "snapshot_frontier": FX + """,
px AS (SELECT r.ann_id, b.x0 AS ox, b.y0 AS oy, b.w, b.h, least(b.w, 32) AS gw, least(b.h, 32) AS gh, r.x0, r.y0, r.x1, r.y1 FROM fx_ref_rects r JOIN fx_ref b USING (ann_id)),
cx AS (SELECT *, unnest(range((x0 - ox) * gw // w, (x1 - 1 - ox) * gw // w + 1)) AS gx FROM px), cells AS (SELECT DISTINCT ann_id, gx, unnest(range((y0 - oy) * gh // h, (y1 - 1 - oy) * gh // h + 1)) AS gy FROM cx),
inner_cells AS (SELECT c.ann_id, c.gx, c.gy FROM cells c JOIN cells l ON l.ann_id = c.ann_id AND l.gx = c.gx - 1 AND l.gy = c.gy JOIN cells r ON r.ann_id = c.ann_id AND r.gx = c.gx + 1 AND r.gy = c.gy
 JOIN cells u ON u.ann_id = c.ann_id AND u.gx = c.gx AND u.gy = c.gy - 1 JOIN cells d ON d.ann_id = c.ann_id AND d.gx = c.gx AND d.gy = c.gy + 1)
SELECT c.ann_id, count(*) AS cells FROM cells c ANTI JOIN inner_cells i ON i.ann_id = c.ann_id AND i.gx = c.gx AND i.gy = c.gy GROUP BY c.ann_id""",
    "mask_distance_pairs": FX + _SMALL + "SELECT image_id, a, b FROM gaps WHERE a < b AND gap <= 4",
    "mask_relations": FX + _SMALL + """SELECT g.image_id, a, b, CASE WHEN hits::DOUBLE / (x.area + y.area - hits) >= 0.3 OR hits::DOUBLE / x.area >= 0.5 THEN 'dup' WHEN hits::DOUBLE / y.area >= 0.5 THEN 'subsumes' ELSE 'none' END AS relation
 FROM gaps g JOIN sz x ON x.ann_id = g.a JOIN sz y ON y.ann_id = g.b WHERE hits > 0""",
    "merged_blobs": FX + _SMALL + """SELECT DISTINCT one.image_id, one.a FROM gaps one JOIN gaps two ON two.a = one.a AND two.b > one.b JOIN gaps far ON far.a = one.b AND far.b = two.b WHERE one.hits > 0 AND two.hits > 0 AND far.gap > 4""",
    "draw_masks": FX + """,
sh AS (SELECT image_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM fx_ref WHERE image_id < 12 UNION ALL SELECT DISTINCT image_id, 100, 100, 300, 250 FROM fx_ref WHERE image_id < 12)""" + _COLS.format(keys="image_id", table="sh") + """
SELECT image_id, sum(b - a - CASE WHEN x >= 200 AND x < 400 THEN greatest(0, least(b, 600) - greatest(a, 200)) ELSE 0 END)::BIGINT AS area, false AS erased FROM spans GROUP BY image_id""",
}

QUERIES = {f.__name__: f for f in (
    mask_pair_iou, eval_mask_outcomes, eval_mask_report, eval_mask_splits, eval_rows, eval_index, eval_spine, mask_shapes, mask_annotations, mask_wire, mask_rectangles, mask_window,
    mask_splice, mask_upscale, mask_sample, mask_covered, mask_union_shapes, export_masks, export_forced, integer_rects, mask_keys, snapshot_cells, snapshot_frontier, mask_distance_pairs,
    mask_relations, merged_blobs, draw_masks,
)}
