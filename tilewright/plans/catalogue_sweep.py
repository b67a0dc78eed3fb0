"""Queries of the sweep's other branches, of delivery and of the request functions, beside their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import statistics as T
from tilewright.operators import sweep as P
from tilewright.plans import fixtures as X
from tilewright.plans import routes
from tilewright.plans.oracles import _TILES
from tilewright.streaming import delivery as Y

FX = X.SQL


def _scenes(spark, d):
    from tilewright.plans.catalogue import _scenes as scenes

    return scenes(spark, d)


def sweep_novel(spark, d):
    """Survivors with novelty, back-off, packed canvases and two scales of exemplar shots."""
    knobs = P.SweepParams.resolve(novel=True, retries=2, pack=2, scales=(1.0, 1.5), offsets=((0.0, 0.0), (0.25, 0.0)))
    return P.run_sweeps(_scenes(spark, d), knobs, survivors=True)


def sweep_rebatch(spark, d):
    """Canvases of packed clusters per image."""
    events = P.run_sweeps(_scenes(spark, d), P.SweepParams.resolve(pack=3), last="clusters")
    return events.where("type = 'rebatch'").select("image_id", "n")


def sweep_start(spark, d):
    return P.run_sweeps(_scenes(spark, d), last="tiles").where("type IN ('start', 'batch')").groupBy("image_id").agg(F.max(F.when(F.col("type") == "start", F.col("n"))).alias("tiles"), F.count_if(F.col("type") == "batch").alias("batches"), F.sum(F.when(F.col("type") == "batch", F.col("n"))).alias("landed"))


def cluster_plan(spark, d):
    """Tiles around three-box hulls: expanded, at least 256, inside the image."""
    rows = _scenes(spark, d).withColumn("shot", F.col("ann_id") % 4)
    hulls = rows.groupBy("image_id", "shot").agg(F.min("x0").alias("hx0"), F.min("y0").alias("hy0"), F.max("x1").alias("hx1"), F.max("y1").alias("hy1"), F.lit(1.0).alias("scale"))
    sizes = X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    return P.cluster_tiles(hulls, sizes, P.SweepParams()).select("image_id", "shot", "x0", "y0", "x1", "y1")


def retraction_origins(spark, d):
    """First retraction of every origin among detections that cover exactly one."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kept = e.select(F.col("user_id").alias("image_id"), (F.col("event_id") % 6).alias("shot"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array("event_type")).alias("covers"))
    return P.retractions(kept)


def micro_batches(spark, d):
    from tilewright.operators import tiling as L

    return Y.micro_batches(L.grid(X.images(spark, d)).select("image_id", "tile"))


def event_lines(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") % 7).alias("n"))
    return Y.ordered_lines(events)


def failed_streams(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    failures = events.where("type = 'error'").groupBy("image_id").agg(F.min("seq").alias("seq")).withColumn("message", F.concat(F.lit("failed at "), F.col("seq").cast("string")))
    return Y.with_failures(events, failures).select("image_id", "seq", "type", "origin")


def _params(n):
    return F.create_map(F.lit("k"), (F.col("seq") % n).cast("string"))


def queue_left(spark, d):
    log = X.searches(spark, d)
    return Y.not_done(log.withColumn("params", _params(3)), log.withColumn("params", _params(2))).select("image_id", "prompt", "seq")


def latest_requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("client"), F.col("event_id").alias("token"), (F.col("event_id") % 17).alias("image_id"))
    return Y.latest_request(e)


def commit_plan(spark, d):
    log = X.searches(spark, d).withColumn("kept", (F.col("seq") % 3).cast("long"))
    return Y.commit_plan(log).groupBy("commit").agg(F.count("*").alias("n"), F.sum("kept").alias("kept"))


def commit_requeue(spark, d):
    log = X.searches(spark, d).groupBy("image_id", "prompt").agg((F.max("seq") % 3).alias("kept"))
    saved = log.where("image_id % 2 = 0").select("image_id").distinct()
    failed = log.where("image_id % 4 = 0 AND prompt = 'view'").select("image_id", "prompt")
    return Y.pending_after(log, saved, failed).select("image_id", "prompt", "kept")


def redo_label(spark, d):
    rows = X.corners(X.predicted(spark, d)).withColumn("state", F.when(F.col("ann_id") % 2 == 0, "pending").otherwise("saved")).drop("score")
    during = Y.begin_redo(rows, "view")
    found = rows.where("category = 'view' AND ann_id % 5 = 0")
    return Y.end_redo(rows, during, found.drop("state"), "done").groupBy("category", "state").agg(F.count("*").alias("n"))


def refine_boxes(spark, d):
    rows = X.corners(X.reference(spark, d))
    boxes = rows.select("image_id", "category").distinct().withColumns({"seq": F.lit(1), "x0": F.lit(100), "y0": F.lit(100), "x1": F.lit(500), "y1": F.lit(500)})
    return Y.refine(rows, boxes, rows.where("ann_id % 10 = 0").withColumn("ann_id", F.col("ann_id") + 10**7)).select("ann_id")


def route_crop(spark, d):
    rects = X.reference(spark, d).join(X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height"), "image_id").where("x0 < width - 1 AND y0 < height - 1")
    cut = rects.select("ann_id", (F.col("x0") - 20.5).alias("x0"), (F.col("y0") - 20.5).alias("y0"), (F.col("x0") + F.col("w") + 0.5).alias("x1"), (F.col("y0") + F.col("h") + 0.5).alias("y1"), "width", "height")
    return routes.crop_rect(cut).select("ann_id", "x0", "y0", "x1", "y1")


def route_mask_crop(spark, d):
    return routes.mask_crop(X.rects(X.reference(spark, d)), (100, 100, 400, 300)).groupBy("ann_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def route_label_paths(spark, d):
    return routes.label_path(X.categories(spark))


def route_image_eval(spark, d):
    return routes.image_eval(X.corners(X.predicted(spark, d)), X.corners(X.reference(spark, d)), 4, ("tp", "fn")).select("category", "kind", F.col("ref").alias("ref_id"), "iou")


def route_segment(spark, d):
    return routes.segment(X.predicted(spark, d), 0.75).select("ann_id", "score")


def route_dir_counts(spark, d):
    return routes.dir_counts(X.images(spark, d), X.predicted(spark, d))


def label_statistics(spark, d):
    """Mean and population deviation of a label's count per image, images without it included."""
    full = T.outliers(X.images(spark, d), X.predicted(spark, d), [n for _, n, _ in X.CATEGORIES])
    return full.groupBy("category").agg(F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_pop("n"), 9).alias("deviation"))


_SC = """,
sc AS (SELECT p.image_id, p.ann_id, p.score, p.x0::DOUBLE AS x0, p.y0::DOUBLE AS y0, least(p.x0 + p.w, i.width)::DOUBLE AS x1, least(p.y0 + p.h, i.height)::DOUBLE AS y1, i.width, i.height
  FROM fx_pred p JOIN fx_images i ON i.id = p.image_id WHERE p.x0 < i.width AND p.y0 < i.height)"""
_SIDE = "least({w}::DOUBLE, greatest(round_even((h{a}1 - h{a}0) * 1.5::DOUBLE, 0), 256.0))"

ORACLES = {
    "sweep_start": FX + _TILES + _SC + """
SELECT c.image_id, count(DISTINCT c.tile)::BIGINT AS tiles, count(DISTINCT c.tile)::BIGINT AS batches, count(*) FILTER (s.ann_id IS NOT NULL
 AND (greatest(s.x0, c.x0) > c.cx0 OR c.cx0 <= 0) AND (greatest(s.y0, c.y0) > c.cy0 OR c.cy0 <= 0) AND (least(s.x1, c.x1) < c.cx1 OR c.cx1 >= c.width) AND (least(s.y1, c.y1) < c.cy1 OR c.cy1 >= c.height)) AS landed
FROM cores c LEFT JOIN sc s ON s.image_id = c.image_id AND s.x0 < c.x1 AND c.x0 < s.x1 AND s.y0 < c.y1 AND c.y0 < s.y1 GROUP BY c.image_id""",
    "cluster_plan": FX + _SC + f""",
h AS (SELECT image_id, ann_id % 4 AS shot, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1, any_value(width) AS width, any_value(height) AS height FROM sc GROUP BY image_id, ann_id % 4),
t AS (SELECT *, {_SIDE.format(a='x', w='width')} AS sx, {_SIDE.format(a='y', w='height')} AS sy FROM h),
p AS (SELECT *, greatest(0.0, least(round_even((hx0 + hx1) / 2 - sx / 2, 0), width - sx)) AS x0, greatest(0.0, least(round_even((hy0 + hy1) / 2 - sy / 2, 0), height - sy)) AS y0 FROM t)
SELECT image_id, shot, x0, y0, x0 + sx AS x1, y0 + sy AS y1 FROM p""",
    "retraction_origins": "SELECT user_id AS image_id, event_type AS origin, arg_min(event_id % 6, event_id) AS shot, min(event_id) AS ord FROM events WHERE event_id % 4 <> 0 GROUP BY user_id, event_type",
    "micro_batches": FX + _TILES + "SELECT image_id, tile, (tile // 8)::BIGINT AS batch, (tile % 8)::BIGINT AS place FROM tiles",
    "event_lines": """SELECT user_id AS image_id, event_id AS seq, '{"event_type":"' || event_type || '","n":' || event_id % 7 || '}' AS line FROM events""",
    "failed_streams": """WITH f AS (SELECT user_id, min(event_id) AS s FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id AS image_id, event_id AS seq, event_type AS type, NULL AS origin FROM events e LEFT JOIN f USING (user_id) WHERE s IS NULL OR event_id < s UNION ALL SELECT user_id, s, 'error', 'failed at ' || s FROM f""",
    "queue_left": FX + "SELECT image_id, prompt, seq FROM fx_searches q WHERE NOT EXISTS (SELECT 1 FROM fx_searches s WHERE s.completed AND s.image_id = q.image_id AND s.prompt = q.prompt AND s.seq % 2 = q.seq % 3)",
    "latest_requests": "SELECT user_id AS client, max(event_id) AS token, arg_max(event_id % 17, event_id) AS image_id FROM events GROUP BY user_id",
    "commit_plan": FX + "SELECT CASE WHEN seq % 3 = 0 THEN 'now' ELSE 'with_save' END AS commit, count(*) AS n, sum(seq % 3)::BIGINT AS kept FROM fx_searches GROUP BY 1",
    "commit_requeue": FX + """, r AS (SELECT image_id, prompt, max(seq) % 3 AS kept FROM fx_searches GROUP BY ALL)
SELECT image_id, prompt, kept FROM r WHERE (image_id % 2 <> 0 AND kept > 0) OR (image_id % 4 = 0 AND prompt = 'view')""",
    "redo_label": FX + """SELECT category, state, count(*) AS n FROM (
 SELECT category, CASE WHEN category = 'view' AND ann_id % 2 = 0 THEN 'dropped' WHEN category = 'view' THEN 'staged' WHEN ann_id % 2 = 0 THEN 'pending' ELSE 'saved' END AS state FROM fx_pred
 UNION ALL SELECT category, 'pending' FROM fx_pred WHERE category = 'view' AND ann_id % 5 = 0) WHERE state <> 'dropped' GROUP BY ALL""",
    "refine_boxes": FX + "SELECT ann_id FROM fx_ref WHERE NOT (x0 + w / 2.0 BETWEEN 100 AND 500 AND y0 + h / 2.0 BETWEEN 100 AND 500) UNION ALL SELECT ann_id + 10000000 FROM fx_ref WHERE ann_id % 10 = 0",
    "route_crop": FX + """SELECT r.ann_id, greatest(0, least(round_even(x0 - 20.5::DOUBLE, 0), width))::BIGINT AS x0, greatest(0, least(round_even(y0 - 20.5::DOUBLE, 0), height))::BIGINT AS y0, greatest(0, least(round_even(x0 + w + 0.5::DOUBLE, 0), width))::BIGINT AS x1,
 greatest(0, least(round_even(y0 + h + 0.5::DOUBLE, 0), height))::BIGINT AS y1 FROM fx_ref r JOIN fx_images i ON i.id = r.image_id WHERE x0 < width - 1 AND y0 < height - 1""",
    "route_mask_crop": X.MASK_SQL + """SELECT ann_id, sum((least(x1, 400) - greatest(x0, 100)) * (least(y1, 300) - greatest(y0, 100)))::BIGINT AS area FROM fx_ref_rects WHERE greatest(x0, 100) < least(x1, 400) AND greatest(y0, 100) < least(y1, 300) GROUP BY ann_id""",
    "route_label_paths": "SELECT * FROM (VALUES ('view', 'view'), ('click', 'view/click'), ('purchase', 'view/click/purchase'), ('signup', 'view/signup'), ('error', 'system/error')) v(name, path)",
    "route_image_eval": FX + "SELECT r.category, CASE WHEN m.pred IS NULL THEN 'fn' ELSE 'tp' END AS kind, r.ann_id AS ref_id, round_even(m.iou * 10000, 0) / 10000.0::DOUBLE AS iou FROM fx_ref r LEFT JOIN fx_matches m ON m.image_id = r.image_id AND m.category = r.category AND m.ref = r.ann_id WHERE r.image_id = 4",
    "route_segment": FX + "SELECT ann_id, score FROM fx_pred WHERE score >= 0.75",
    "route_dir_counts": FX + "SELECT i.file_name, n.category, coalesce(n.n, 0) AS n FROM fx_images i LEFT JOIN (SELECT image_id, category, count(*) AS n FROM fx_pred GROUP BY ALL) n ON n.image_id = i.id",
    "label_statistics": FX + """SELECT category, round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS deviation FROM (
 SELECT i.id, c.name AS category, count(p.ann_id) AS n FROM fx_images i CROSS JOIN fx_categories c LEFT JOIN fx_pred p ON p.image_id = i.id AND p.category = c.name GROUP BY ALL) GROUP BY category""",
}

QUERIES = {f.__name__: f for f in (
    sweep_novel, sweep_rebatch, sweep_start, cluster_plan, retraction_origins, micro_batches, event_lines, failed_streams, queue_left, latest_requests, commit_plan, commit_requeue, redo_label,
    refine_boxes, route_crop, route_mask_crop, route_label_paths, route_image_eval, route_segment, route_dir_counts, label_statistics,
)}
