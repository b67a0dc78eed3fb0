"""Queries of the review views, transactions, listings and messages, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators import dataset as D
from tilewright.operators import evaluation as E
from tilewright.operators import review as V
from tilewright.operators import statistics as T
from tilewright.operators import transactions as A
from tilewright.plans import fixtures as X
from tilewright.plans.oracles import _CLIMB, _OUTCOMES, ORACLES as _BASE, _r
from tilewright.sources import files as S

FX = X.SQL


def _boxes(spark, d):
    return X.corners(X.predicted(spark, d))


def _files(spark, d):
    """Image names in folders of both kinds of separator, some in capitals."""
    odd = F.when(F.col("id") % 3 == 0, F.concat(F.lit("set\\Day "), F.col("id").cast("string"), F.lit("\\"), F.upper("file_name"))).otherwise(F.concat(F.lit("set/"), "file_name"))
    return X.images(spark, d).withColumn("file_name", odd)


_FILES = """,
fl AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'set\\Day ' || id || '\\' || upper(file_name) ELSE 'set/' || file_name END AS file_name FROM fx_images)
"""


def file_names(spark, d):
    name = F.col("file_name")
    return _files(spark, d).select("id", V.base_name(name).alias("base"), V.directory_of(name).alias("directory"), V.same_path(name, F.lit("SET/IMG_7.png")).alias("same"))


def annotations_of_image(spark, d):
    return V.of_image(X.reference(spark, d), _files(spark, d), "img_7.png").select("ann_id")


def positional_subset(spark, d):
    return V.at_positions(X.reference(spark, d), ["ann_id"], [0, 2, 5, 100000]).select("image_id", "ann_id", "position")


def image_endings(spark, d):
    return V.with_endings(_files(spark, d).withColumn("file_name", F.when(F.col("id") % 5 == 0, F.regexp_replace("file_name", "(?i)png$", "JPG")).otherwise(F.col("file_name"))), ".png, jpeg tif").select("id")


def visible_instances(spark, d):
    rows = _boxes(spark, d).withColumn("step", (F.col("ann_id") % 3 + 1).cast("int")).withColumn("score", F.when(F.col("ann_id") % 5 != 0, F.col("score")))
    return V.visible(rows, ["error"], [1, 3], 0.5).select("ann_id")


def tree_search(spark, d):
    return V.tree_filter(X.categories(spark), "CLI").select("id", "name")


def subtree_names(spark, d):
    return V.subtree(X.categories(spark), "view")


def parent_options(spark, d):
    return V.parent_options(X.categories(spark), "click")


def label_forest(spark, d):
    own = X.reference(spark, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    shown = V.forest(X.categories(spark), own)
    return shown.select("name", "id", "depth", "total", F.array_join(F.transform("path", lambda p: p["name"]), "/").alias("path"))


def completed_lookup(spark, d):
    params = lambda swap: F.when(swap, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), (F.col("seq") % 3).cast("string")))
    log = X.searches(spark, d)
    wanted = log.select("image_id", "prompt", "seq", params(F.col("seq") % 2 == 0).alias("params")).where("seq % 7 = 0")
    return V.completed_search(log.withColumn("params", params(F.col("seq") % 4 == 0)), wanted).select("image_id", "prompt", "seq")


def box_selection(spark, d):
    rows = _boxes(spark, d).withColumn("state", F.when(F.col("ann_id") % 2 == 0, "pending").otherwise("saved"))
    return V.boxed(rows, (200, 200, 600, 500)).groupBy("state").agg(F.count("*").alias("n"))


def overlay_kinds(spark, d):
    return V.overlays(E.outcomes(_boxes(spark, d), X.corners(X.reference(spark, d))), ["fp", "fn"]).groupBy("kind", "category").agg(F.count("*").alias("n"))


def oversized_boxes(spark, d):
    boxes = _boxes(spark, d)
    return V.oversized(boxes, V.object_scale(boxes), 1.2).select("image_id", "ann_id")


def known_labels(spark, d):
    wanted = spark.createDataFrame([("view",), ("nothing",), ("error",), ("system",)], "name string")
    return V.known_only(wanted, X.categories(spark))


def filmstrip(spark, d):
    return V.filmstrip(X.images(spark, d).withColumn("directory", (F.col("id") % 4).cast("long")))


def prompt_history(spark, d):
    docs = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("prompt"), F.col("event_id").alias("seq"))
    return V.history(docs)


def tile_exemplars(spark, d):
    images = X.images(spark, d).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("tile"))
    x, y = (F.col("tile") % 3) * 300, F.floor(F.col("tile") / 3) * 300
    tiles = images.select("image_id", "tile", (F.col("image_id") * 3).cast("long").alias("prefer"), x.cast("long").alias("x0"), y.cast("long").alias("y0"), (x + 400).cast("long").alias("x1"), (y + 400).cast("long").alias("y1"))
    return V.exemplars(tiles, _boxes(spark, d).select("image_id", "ann_id", "score", "x0", "y0", "x1", "y1"), 4, rotate=1)


def tile_telemetry(spark, d):
    seen = _boxes(spark, d).select("image_id", (F.col("ann_id") % 4).cast("int").alias("tile"), ((F.col("ann_id") * 37 % 1000) / 100 - 5).alias("logit"))
    out = V.tile_telemetry(seen, 0.5, 3)
    return out.select("image_id", "tile", F.array_join(F.transform("top", lambda p: F.round(p * 1000000).cast("long").cast("string")), ",").alias("top"), "kept")


def best_masks(spark, d):
    rows = X.predicted(spark, d).select("image_id", F.col("category").alias("prompt"), "ann_id", F.round("score", 1).alias("quality"))
    return V.best_mask(rows)


def worst_categories(spark, d):
    found = E.outcomes(_boxes(spark, d), X.corners(X.reference(spark, d)))
    report = E.report(found, X.images(spark, d)).where("level = 2").select("category", "f1")
    return V.worst_first(report, "f1")


def name_changes(spark, d):
    after = spark.createDataFrame([("view",), ("tap",), ("error",), ("error",), ("signup",)], "name string")
    return V.name_changes(X.categories(spark).select("name"), after)


def common_categories(spark, d):
    pred = spark.createDataFrame([("error",), ("view",), ("other",), ("purchase",)], "name string")
    return V.common_categories(X.categories(spark), pred)


def category_union(spark, d):
    ref, pred = X.reference(spark, d).where("image_id = 5"), X.predicted(spark, d).where("image_id = 5")
    return ref.select("category").union(pred.select("category")).distinct()


def occupied_bins(spark, d):
    return V.bin_range(T.area_histogram(X.reference(spark, d)).withColumn("bin", F.col("bin").cast("int")))


def time_left(spark, d):
    progress = T.pace(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("value").cast("double").alias("value")), "user_id", "value", "event_id")
    job = progress.select("user_id", F.floor("pace").alias("tile_pace"), (F.floor("pace") * 20).alias("image_pace"), F.lit(30).alias("tiles_total"), (F.col("user_id") % 30).alias("tiles_done"), F.lit(500).alias("images_total"), (F.col("user_id") % 500).alias("images_done"))
    return V.time_left(job).select("user_id", F.col("image_left").cast("double").alias("image_left"), F.col("all_left").cast("double").alias("all_left"))


def packed_forwards(spark, d):
    return V.packed_forwards(X.reference(spark, d).select("image_id", (F.col("ann_id") % 23).alias("cluster")), 3).select("image_id", F.col("forwards").cast("long").alias("forwards"))


def cache_figures(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return V.cache_figures(events.select((F.col("event_id") % 3 != 0).alias("hit")), events.select((100 + F.col("event_id") % 50).alias("raw_bytes"), (40 + F.col("event_id") % 20).alias("stored_bytes")))


def eviction_plan(spark, d):
    files = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("source"), F.col("event_id").alias("modified"), (10 + F.col("event_id") % 7).alias("bytes"))
    return V.eviction_plan(files, 60_000, 5_000, 3)


def dashboard(spark, d):
    pred, ref = _boxes(spark, d), X.corners(X.reference(spark, d))
    return V.dashboard(E.image_scores(E.outcomes(pred, ref)), ref, pred, X.images(spark, d))


def directory_counts(spark, d):
    files, names = X.images(spark, d), _files(spark, d).select(F.col("id").alias("image_id"), "file_name")
    return V.directory_counts(files.where("id % 2 = 0").select("file_name"), X.reference(spark, d).join(names, "image_id"), X.predicted(spark, d).where("ann_id % 2 = 0").join(names, "image_id"))


def form_numbers(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 5 == 1, "abc").when(F.col("event_id") % 5 == 2, F.concat(F.lit(" "), (F.col("event_id") % 200).cast("string"), F.lit(" "))).otherwise(F.concat((F.col("event_id") % 200).cast("string"), F.lit(".5")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", V.lenient_number(text, 7, 0, 100).alias("any"), V.lenient_number(text, 7, 0, 100, whole=True).alias("whole"))


def group_response(spark, d):
    boxes = _boxes(spark, d)
    groups = boxes.select("image_id", "category", "ann_id", F.min("ann_id").over(W.partitionBy("image_id", "category", F.col("ann_id") % 3)).alias("seed"))
    out = V.group_response(groups, boxes, E.GROUP)
    return out.select("image_id", "category", "seed", F.array_join("members", ",").alias("members"), "x0", "y0", "x1", "y1")


def current_generation(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("image_id"), (F.col("event_id") % 3).alias("generation"))
    newest = events.groupBy("image_id").agg(F.max("generation").alias("generation"))
    return V.stale_generation(events, newest).select("event_id")


# ------------------------------------------------------------- transactions


def _dataset(spark, d):
    images = X.images(spark, d).select(F.col("id").cast("long").alias("id"), "file_name", "width", "height")
    cats = X.categories(spark)
    rows = X.reference(spark, d).join(F.broadcast(cats.select(F.col("name").alias("category"), F.col("id").alias("category_id"))), "category")
    return A.Dataset(images, cats, rows.select("ann_id", F.col("image_id").cast("long").alias("image_id"), "category_id", "x0", "y0", "w", "h"))


def save_transaction(spark, d):
    data = _dataset(spark, d)
    gone = data.annotations.where("ann_id % 50 = 1").drop("category_id")
    new = X.predicted(spark, d).where("image_id = 3").select(F.when(F.col("category") == "view", "zoom").otherwise(F.col("category")).alias("category"), "x0", "y0", "w", "h", F.col("ann_id").alias("order"))
    after, _ = A.save(data, "new image.png", 640, 480, gone, new)
    named = after.annotations.join(after.images.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(after.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    return named.where("file_name = 'new image.png' OR image_id < 6").select("ann_id", "file_name", "name", "x0", "y0", "w", "h")


def delete_one(spark, d):
    data = _dataset(spark, d)
    return A.delete(data, data.annotations.where("ann_id = 77").drop("category_id")).annotations.groupBy("image_id").agg(F.count("*").alias("n"))


def edit_labels(spark, d):
    data, removed = A.edit_labels(_dataset(spark, d), "drop", ["click"])
    data, _ = A.edit_labels(data, "add", ["extra"])
    data, _ = A.edit_labels(data, "parent", ["signup"], "error")
    return data.categories.select("id", "name", "supercategory", F.lit(removed).cast("long").alias("removed"))


def replaced_rows(spark, d):
    ref = X.reference(spark, d)
    changed = ref.where("ann_id % 4 = 0").withColumn("w", F.col("w") + 1).union(ref.limit(1).withColumn("ann_id", F.lit(10**9).cast("long")))
    return A.replace_rows(ref, changed).select("ann_id", "w")


def save_request(spark, d):
    pending = X.predicted(spark, d).select("image_id", (F.col("ann_id") % 3 != 0).alias("ticked"))
    saved = X.reference(spark, d).where("image_id % 2 = 0").select("image_id", (F.col("ann_id") % 4 == 0).alias("staged"))
    return A.request(pending, saved)


def merge_pending(spark, d):
    rows = _boxes(spark, d).select("image_id", (F.col("ann_id") % 5).alias("seed"), "ann_id", (F.col("ann_id") % 11 == 0).alias("saved"), "score", "x0", "y0", "x1", "y1")
    return A.merge_pending(rows)


def fingerprint_status(spark, d):
    base = X.images(spark, d).select("file_name", "id").select(F.col("file_name").alias("name"), (F.col("id") * 10).alias("size"), (F.col("id") + 5).alias("modified"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), "id")
    files = base.select("name", F.when(F.col("id") % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 4 == 0, F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"), F.when(F.col("id") % 8 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return A.fingerprint_status(base.where("id % 7 <> 0").drop("id"), files)


def search_upsert(spark, d):
    log = X.searches(spark, d).select(F.col("image_id").cast("string").alias("name"), "prompt", F.col("seq").alias("position"), F.lit(100).alias("width"), F.lit(80).alias("height"), "completed")
    old, new = (D.latest(log.where(w).withColumnRenamed("position", "seq"), ["name", "prompt"], "seq").drop("seq") for w in ("position % 3 = 0", "position % 3 = 1"))
    status = old.select("name").distinct().withColumn("status", F.when(F.col("name").cast("int") % 5 == 0, "invalid").when(F.col("name").cast("int") % 5 == 1, "revalidated").otherwise("valid"))
    return A.upsert_searches(old, new.withColumn("width", F.lit(200)), status).select("name", "prompt", "position", "width", "height", "completed")


# ------------------------------------------------------------- listings and messages


def directory_listing(spark, d):
    docs = spark.read.parquet(f"{d}/pages.parquet")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", "_mask.tiff", ".txt", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    listing = docs.select(F.concat(F.when(F.col("page_id") % 11 == 0, ".").otherwise(""), F.lit("Item"), F.col("page_id").cast("string"), ending).alias("name"), (F.col("page_id") % 5 == 4).alias("is_directory"))
    return S.directory_entries(listing, "item5.PNG. ")


def event_messages(spark, d):
    """Lines of JSON cut into chunks of seven characters and put together again."""
    users = spark.read.parquet(f"{d}/events.parquet").where("user_id < 40").select("user_id", "event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))
    whole = users.groupBy(F.col("user_id").alias("stream")).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n{broken\n\n")).alias("body"))
    chunks = whole.select("stream", F.posexplode(F.expr("transform(sequence(0, length(body) div 7), i -> substring(body, i * 7 + 1, 7))")).alias("chunk", "value"))
    return S.parse_lines(chunks, "event_id bigint, event_type string").select(F.col("stream").alias("user_id"), "event_id", "event_type")


def stored_history(spark, d):
    text = F.when(F.col("user_id") % 3 == 0, F.lit("not json")).when(F.col("user_id") % 3 == 1, F.concat(F.lit('["a", "b'), F.col("user_id").cast("string"), F.lit('"]')))
    stored = X.images(spark, d).select(F.col("id").alias("user_id")).select("user_id", text.alias("stored"))
    return S.parse_history(stored).select("user_id", F.size("prompts").cast("long").alias("n"), F.array_join("prompts", ",").alias("prompts"))


def data_urls(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.data_url(F.encode("c_name", "UTF-8"), "text/plain").alias("url"))


ORACLES = {
    "file_names": FX + _FILES + r"SELECT id, regexp_extract(file_name, '[^/\\]*$') AS base, regexp_extract(file_name, '^(.*)[/\\][^/\\]*$', 1) AS directory, lower(replace(file_name, '\', '/')) = 'set/img_7.png' AS same FROM fl",
    "annotations_of_image": FX + "SELECT ann_id FROM fx_ref WHERE image_id = 7",
    "positional_subset": FX + "SELECT * FROM (SELECT image_id, ann_id, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS position FROM fx_ref) WHERE position IN (0, 2, 5)",
    "image_endings": FX + "SELECT id FROM fx_images WHERE id % 5 <> 0",
    "visible_instances": FX + "SELECT ann_id FROM fx_pred WHERE category <> 'error' AND ann_id % 3 IN (0, 2) AND (ann_id % 5 = 0 OR score >= 0.5)",
    "tree_search": FX + "SELECT id, name FROM fx_categories WHERE name IN ('click', 'view')",
    "subtree_names": FX + _CLIMB + "SELECT name FROM climb WHERE ancestor = 'view' UNION SELECT 'view'",
    "parent_options": FX + _CLIMB + "SELECT name FROM (SELECT name FROM fx_categories UNION SELECT supercategory FROM fx_categories WHERE supercategory <> '') WHERE name <> 'click' AND name NOT IN (SELECT name FROM climb WHERE ancestor = 'click')",
    "label_forest": FX + _CLIMB + """,
own AS (SELECT c.name, count(r.ann_id) AS own FROM fx_categories c LEFT JOIN fx_ref r ON r.category = c.name GROUP BY c.name),
spread AS (SELECT name, own FROM own UNION ALL SELECT ancestor, own FROM climb JOIN own USING (name)), totals AS (SELECT name, sum(own)::BIGINT AS total FROM spread GROUP BY name),
up AS (SELECT name, max(depth) AS depth, string_agg(ancestor, '/' ORDER BY depth DESC) AS above FROM climb GROUP BY name)
SELECT t.name, c.id, coalesce(u.depth, 0)::BIGINT AS depth, t.total, CASE WHEN u.above IS NULL THEN t.name ELSE u.above || '/' || t.name END AS path FROM totals t LEFT JOIN fx_categories c USING (name) LEFT JOIN up u USING (name)""",
    "completed_lookup": FX + """,
s AS (SELECT *, CASE WHEN seq % 4 = 0 THEN '1,2' ELSE '1,' || seq % 3 END AS k FROM fx_searches WHERE completed), w AS (SELECT *, CASE WHEN seq % 2 = 0 THEN '1,2' ELSE '1,' || seq % 3 END AS k FROM fx_searches WHERE seq % 7 = 0)
SELECT image_id, prompt, seq FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.image_id = w.image_id AND s.prompt = w.prompt AND s.k = w.k)""",
    "box_selection": FX + """SELECT CASE WHEN (2 * x0 + w) / 2.0 BETWEEN 200 AND 600 AND (2 * y0 + h) / 2.0 BETWEEN 200 AND 500 THEN CASE WHEN ann_id % 2 = 0 THEN 'dropped' ELSE 'staged' END WHEN ann_id % 2 = 0 THEN 'pending' ELSE 'saved' END AS state, count(*) AS n FROM fx_pred GROUP BY 1""",
    "overlay_kinds": FX + _OUTCOMES + "SELECT kind, category, count(*) AS n FROM fx_found WHERE kind IN ('fp', 'fn') GROUP BY ALL",
    "oversized_boxes": FX + "SELECT p.image_id, p.ann_id FROM fx_pred p JOIN (SELECT image_id, median(greatest(w, h)) AS s FROM fx_pred GROUP BY image_id) m USING (image_id) WHERE w * h > 1.2::DOUBLE * s * s",
    "known_labels": "SELECT unnest(['view', 'error']) AS name",
    "filmstrip": FX + """SELECT directory, file_name, greatest(0, least(pos - 5, n - 12)) AS first, least(greatest(0, least(pos - 5, n - 12)) + 12, n) AS last FROM (
 SELECT (id % 4)::BIGINT AS directory, file_name, row_number() OVER (PARTITION BY id % 4 ORDER BY lower(file_name), file_name) - 1 AS pos, count(*) OVER (PARTITION BY id % 4) AS n FROM fx_images)""",
    "prompt_history": """SELECT * FROM (SELECT user_id, prompt, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) - 1 AS rank FROM (
 SELECT user_id, event_type || event_id % 9 AS prompt, max(event_id) AS seq FROM events GROUP BY ALL)) WHERE rank < 30""",
    "tile_exemplars": FX + """,
t AS (SELECT id AS image_id, tile, id * 3 AS prefer, (tile % 3) * 300 AS x0, (tile // 3) * 300 AS y0 FROM fx_images, (SELECT unnest(range(0, 9))::INT AS tile)),
h AS (SELECT t.image_id, t.tile, p.ann_id, p.score, p.ann_id = t.prefer AS pinned, (2 * t.x0 + 400 - 2 * p.x0 - p.w) ** 2 + (2 * t.y0 + 400 - 2 * p.y0 - p.h) ** 2 AS far FROM t JOIN fx_pred p ON p.image_id = t.image_id
 AND p.x0 >= t.x0 + 20 AND p.y0 >= t.y0 + 20 AND p.x0 + p.w <= t.x0 + 380 AND p.y0 + p.h <= t.y0 + 380),
a AS (SELECT *, row_number() OVER (PARTITION BY image_id, tile ORDER BY far, ann_id) - 1 AS pos, count(*) OVER (PARTITION BY image_id, tile) AS n FROM h),
b AS (SELECT *, (pos - 1 + n) % n AS turn FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY image_id, tile ORDER BY pinned DESC, turn) AS pick FROM b)
SELECT image_id, tile, ann_id, row_number() OVER (PARTITION BY image_id, tile ORDER BY pinned DESC, score DESC, turn) - 1 AS place FROM c WHERE pick <= 4""",
    "tile_telemetry": FX + """,
p AS (SELECT image_id, (ann_id % 4)::INT AS tile, 1 / (1 + exp(-((ann_id * 37 % 1000) / 100.0::DOUBLE - 5))) AS p FROM fx_pred)
SELECT image_id, tile, array_to_string(list_transform(list_sort(list(round(p, 6)), 'DESC')[1:3], lambda x: round(x * 1000000, 0)::BIGINT::VARCHAR), ',') AS top, count(*) FILTER (p >= 0.5) AS kept FROM p GROUP BY image_id, tile""",
    "best_masks": FX + "SELECT image_id, category AS prompt, arg_max(ann_id, (round(score, 1), -ann_id)) AS ann_id FROM fx_pred GROUP BY ALL",
    "worst_categories": FX + _OUTCOMES + f""",
s AS (SELECT category, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM fx_found GROUP BY category)
SELECT category, {_r('(2 * tp)', '2 * tp + fp + fn')} AS f1, row_number() OVER (ORDER BY {_r('(2 * tp)', '2 * tp + fp + fn')}, category) - 1 AS rank FROM s""",
    "name_changes": "SELECT * FROM (VALUES ('view', 'kept'), ('tap', 'new'), ('error', 'duplicate'), ('signup', 'kept'), ('click', 'vanished'), ('purchase', 'vanished')) v(name, change)",
    "common_categories": "SELECT * FROM (VALUES ('view', 0::BIGINT), ('purchase', 1), ('error', 2)) v(name, position)",
    "category_union": FX + "SELECT category FROM fx_ref WHERE image_id = 5 UNION SELECT category FROM fx_pred WHERE image_id = 5",
    "occupied_bins": FX + "SELECT min(b)::INT AS first, max(b)::INT AS last FROM (SELECT least(greatest(length(bin(w * h)) - 5, 0), 19) AS b FROM fx_ref)",
    "time_left": """SELECT user_id, round(p * (30 - user_id % 30), 3) AS image_left, round(coalesce(p * (30 - user_id % 30), 0) + p * 20 * greatest(500 - user_id % 500 - 1, 0), 3) AS all_left FROM (SELECT user_id, floor(pace)::DOUBLE AS p FROM (""" + _BASE["ewma_pace"] + "))",
    "packed_forwards": FX + "SELECT image_id, ceil(count(DISTINCT ann_id % 23) / 9.0)::BIGINT AS forwards FROM fx_ref GROUP BY image_id",
    "cache_figures": """SELECT count(*) FILTER (event_id % 3 <> 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses, sum(100 + event_id % 50)::BIGINT AS raw_bytes, sum(40 + event_id % 20)::BIGINT AS stored_bytes,
 (count(*) FILTER (event_id % 3 <> 0))::DOUBLE / count(*) AS hit_rate, sum(100 + event_id % 50)::DOUBLE / sum(40 + event_id % 20)::DOUBLE AS compression FROM events""",
    "eviction_plan": """,
s AS (SELECT user_id AS source, max(event_id) AS used, sum(10 + event_id % 7)::BIGINT AS bytes FROM events GROUP BY user_id),
o AS (SELECT *, coalesce(sum(CASE WHEN source <> 3 THEN bytes ELSE 0 END) OVER (ORDER BY used, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older, sum(bytes) OVER () AS total FROM s)
SELECT source, bytes, source <> 3 AND total - older > 55000 AS evict FROM o""".replace(",\ns AS", "WITH s AS", 1),
    "dashboard": FX + _OUTCOMES + f""",
s AS (SELECT image_id, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM fx_found GROUP BY image_id)
SELECT i.file_name, (SELECT count(*) FROM fx_ref r WHERE r.image_id = i.id) AS n_ref, (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.id) AS n_pred,
 (SELECT count(DISTINCT category) FROM (SELECT image_id, category FROM fx_ref UNION ALL SELECT image_id, category FROM fx_pred) u WHERE u.image_id = i.id) AS categories, coalesce({_r('(2 * s.tp)', '2 * s.tp + s.fp + s.fn')}, 0) AS f1
FROM fx_images i LEFT JOIN s ON s.image_id = i.id""",
    "directory_counts": FX + "SELECT i.file_name, (SELECT count(*) FROM fx_ref r WHERE r.image_id = i.id) AS n_ref, (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.id AND p.ann_id % 2 = 0) AS n_pred FROM fx_images i WHERE i.id % 2 = 0",
    "form_numbers": """SELECT event_id, CASE WHEN event_id % 5 = 2 AND event_id % 200 <= 100 THEN event_id % 200 WHEN event_id % 5 > 2 AND event_id % 200 + 0.5 <= 100 THEN event_id % 200 + 0.5 ELSE 7 END::DOUBLE AS "any",
 CASE WHEN event_id % 5 = 2 AND event_id % 200 <= 100 THEN event_id % 200 ELSE 7 END::DOUBLE AS whole FROM events""",
    "group_response": FX + """SELECT image_id, category, min(ann_id) AS seed, string_agg(ann_id::VARCHAR, ',' ORDER BY ann_id) AS members, CASE WHEN count(*) > 1 THEN min(x0)::DOUBLE END AS x0, CASE WHEN count(*) > 1 THEN min(y0)::DOUBLE END AS y0,
 CASE WHEN count(*) > 1 THEN max(x0 + w)::DOUBLE END AS x1, CASE WHEN count(*) > 1 THEN max(y0 + h)::DOUBLE END AS y1 FROM fx_pred GROUP BY image_id, category, ann_id % 3""",
    "current_generation": "SELECT event_id FROM events e WHERE event_id % 3 = (SELECT max(event_id % 3) FROM events n WHERE n.user_id = e.user_id)",
    "save_transaction": FX + """,
kept AS (SELECT ann_id, image_id, category, x0, y0, w, h FROM fx_ref WHERE ann_id % 50 <> 1),
fresh AS (SELECT (SELECT max(ann_id) FROM kept) + row_number() OVER (ORDER BY ann_id) AS ann_id, CASE WHEN category = 'view' THEN 'zoom' ELSE category END AS name, x0, y0, w, h FROM fx_pred WHERE image_id = 3)
SELECT ann_id, 'img_' || image_id || '.png' AS file_name, category AS name, x0, y0, w, h FROM kept WHERE image_id < 6 UNION ALL SELECT ann_id, 'new image.png', name, x0, y0, w, h FROM fresh""",
    "delete_one": FX + "SELECT image_id, count(*) AS n FROM fx_ref WHERE ann_id <> 77 GROUP BY image_id",
    "edit_labels": FX + """SELECT id, name, supercategory, (SELECT count(*) FROM fx_ref WHERE category = 'click') AS removed FROM (VALUES (1, 'view', ''), (3, 'purchase', 'view'), (4, 'signup', 'error'), (5, 'error', 'system'), (6, 'extra', '')) v(id, name, supercategory)""",
    "replaced_rows": FX + "SELECT ann_id, CASE WHEN ann_id % 4 = 0 THEN w + 1 ELSE w END AS w FROM fx_ref",
    "save_request": FX + """SELECT i.id AS image_id, (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.id AND ann_id % 3 <> 0) AS n_new, (SELECT count(*) FROM fx_ref r WHERE r.image_id = i.id AND i.id % 2 = 0 AND ann_id % 4 = 0) AS n_deletes,
 (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.id AND ann_id % 3 = 0) AS n_unsaved FROM fx_images i WHERE EXISTS (SELECT 1 FROM fx_pred p WHERE p.image_id = i.id) OR (i.id % 2 = 0)""",
    "merge_pending": FX + "SELECT image_id, ann_id % 5 AS seed, count(*) AS members, max(score) AS score, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1 FROM fx_pred GROUP BY image_id, ann_id % 5 HAVING count(*) FILTER (ann_id % 11 = 0) = 0",
    "fingerprint_status": FX + """SELECT file_name AS name, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 5 = 1 THEN 'invalid' WHEN id % 4 <> 0 THEN 'valid' WHEN id % 8 = 0 THEN 'invalid' ELSE 'revalidated' END AS status FROM fx_images""",
    "search_upsert": FX + """,
l AS (SELECT seq % 3 AS side, image_id, prompt, min(seq) AS position, arg_max(completed, seq) AS completed FROM fx_searches WHERE seq % 3 < 2 GROUP BY ALL),
k AS (SELECT * FROM l WHERE side = 0 AND image_id % 5 <> 0)
SELECT n.image_id::VARCHAR AS name, n.prompt, coalesce(k.position, n.position) AS position, 200 AS width, 80 AS height, n.completed FROM l n LEFT JOIN k ON k.image_id = n.image_id AND k.prompt = n.prompt WHERE n.side = 1
UNION ALL SELECT k.image_id::VARCHAR, k.prompt, k.position, CASE WHEN EXISTS (SELECT 1 FROM l n WHERE n.side = 1 AND n.image_id = k.image_id) THEN 200 ELSE 100 END, 80, k.completed FROM k
 WHERE NOT EXISTS (SELECT 1 FROM l n WHERE n.side = 1 AND n.image_id = k.image_id AND n.prompt = k.prompt)""",
    "directory_listing": """WITH e AS (SELECT CASE WHEN page_id % 11 = 0 THEN '.' ELSE '' END || 'Item' || page_id || ['.png', '.JPG', '_mask.tiff', '.txt', ''][page_id % 5 + 1] AS name, CASE page_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'mask' WHEN 4 THEN 'directory' END AS kind FROM pages)
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY lower(name), name) - 1 AS position, name = 'Item5.png' AS is_wanted FROM e WHERE kind IS NOT NULL AND name NOT LIKE '.%'""",
    "event_messages": "SELECT user_id, event_id, event_type FROM events WHERE user_id < 40",
    "stored_history": FX + "SELECT id AS user_id, CASE WHEN id % 3 = 1 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN id % 3 = 1 THEN 'a,b' || id ELSE '' END AS prompts FROM fx_images",
    "data_urls": "SELECT c_custkey, 'data:text/plain;base64,' || base64(c_name::BLOB) AS url FROM customer",
}

QUERIES = {f.__name__: f for f in (
    file_names, annotations_of_image, positional_subset, image_endings, visible_instances, tree_search, subtree_names, parent_options, label_forest, completed_lookup, box_selection, overlay_kinds,
    oversized_boxes, known_labels, filmstrip, prompt_history, tile_exemplars, tile_telemetry, best_masks, worst_categories, name_changes, common_categories, category_union, occupied_bins, time_left,
    packed_forwards, cache_figures, eviction_plan, dashboard, directory_counts, form_numbers, group_response, current_generation, save_transaction, delete_one, edit_labels, replaced_rows,
    save_request, merge_pending, fingerprint_status, search_upsert, directory_listing, event_messages, stored_history, data_urls,
)}
