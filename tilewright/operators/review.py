"""Views for reviewing a dataset: selections, neighbours, label trees, cache and pace figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.dataset import ancestors, roll_up
from tilewright.operators.spatial import range_join

# ------------------------------------------------------------- selections


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def directory_of(path: Column) -> Column:
    """What stands before the last separator; "" without one."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def same_path(a: Column, b: Column) -> Column:
    """Equal but for case and the direction of slashes."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    return plain(a) == plain(b)


def listed_name(name: Column) -> Column:
    """Form in which names of a listing compare: lower case, without dots and spaces at the end."""
    return F.lower(F.regexp_replace(name, r"[. ]+$", ""))


def of_image(annotations: DataFrame, images: DataFrame, name: str) -> DataFrame:
    """Annotations of the images with this base name."""
    ids = images.where(base_name(F.col("file_name")) == F.lit(name)).select(F.col("id").alias("image_id"))
    return annotations.join(ids, "image_id", "left_semi")


def at_positions(rows: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Rows at these zero-based positions of the order; positions beyond the end are ignored."""
    numbered = rows.withColumn("position", (F.row_number().over(W.partitionBy("image_id").orderBy(*order)) - 1).cast("long"))
    return numbered.where(F.col("position").isin([int(x) for x in positions]))


def extensions(text: Column) -> Column:
    """Endings of a list split at spaces and commas, in lower case and with their dot."""
    parts = F.filter(F.split(F.lower(F.trim(text)), r"[\s,]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))


def with_endings(images: DataFrame, text: str, cap: int | None = None) -> DataFrame:
    """Images whose name ends in one of the endings, in listing order; an empty list takes all.  ``cap`` is a limit the user sets."""
    wanted = extensions(F.lit(text))
    own = F.lower(F.regexp_extract("file_name", r"\.[^.]*$", 0))
    found = images.where((F.size(wanted) == 0) | F.array_contains(wanted, own)).orderBy(F.lower("file_name"), "file_name")
    return found if cap is None else found.limit(cap)


def visible(rows: DataFrame, hidden_labels: Sequence[str], shown_pass: Sequence[int], least_score: float) -> DataFrame:
    """Instances of shown labels and passes whose score, if any, reaches the threshold."""
    return rows.where(~F.col("category").isin(list(hidden_labels)) & F.col("step").isin(list(shown_pass)) & (F.col("score").isNull() | (F.col("score") >= least_score)))


def tree_filter(categories: DataFrame, needle: str) -> DataFrame:
    """Labels that hold the needle, case ignored, or have a descendant that does."""
    hit = categories.where(F.contains(F.lower("name"), F.lit(needle.lower()))).select("name")
    above = ancestors(categories).join(hit, "name", "left_semi").select(F.col("ancestor").alias("name"))
    return categories.join(hit.unionByName(above).distinct(), "name", "left_semi")


def canonical_params(params: Column) -> Column:
    """JSON of a string map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def completed_search(searches: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted searches (image_id, prompt, params) that are already complete with equal parameters, in any order of keys."""
    done = searches.where("completed").select("image_id", "prompt", canonical_params(F.col("params")).alias("key")).distinct()
    return wanted.withColumn("key", canonical_params(F.col("params"))).join(done, ["image_id", "prompt", "key"], "left_semi").drop("key")


def boxed(rows: DataFrame, rect: Sequence[float]) -> DataFrame:
    """What a drawn rectangle does to instances centred in it: pending ones are dropped, saved ones staged for deletion."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.lit(rect[0]), F.lit(rect[2])) & cy.between(F.lit(rect[1]), F.lit(rect[3]))
    return rows.withColumn("state", F.when(inside & (F.col("state") == "pending"), "dropped").when(inside & (F.col("state") == "saved"), "staged").otherwise(F.col("state")))


def overlays(found: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return found.where(F.col("kind").isin(list(kinds)))


def oversized(boxes: DataFrame, scale: DataFrame, factor: float = 4.0) -> DataFrame:
    """Boxes larger than ``factor`` times the square of their image's object scale."""
    return boxes.join(scale, "image_id").where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > factor * F.col("scale") * F.col("scale"))


def object_scale(boxes: DataFrame) -> DataFrame:
    """(image_id, scale): median long side."""
    return boxes.groupBy("image_id").agg(F.median(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("scale"))


def known_only(labels: DataFrame, categories: DataFrame) -> DataFrame:
    """Requested label names that exist."""
    return labels.join(categories.select("name").distinct(), "name", "left_semi")


# ------------------------------------------------------------- windows and top-k


def filmstrip(images: DataFrame, width: int = 12) -> DataFrame:
    """(directory, file_name, first, last): the window of at most ``width`` neighbours around every image, moved inside at the ends."""
    by = W.partitionBy("directory")
    at = F.row_number().over(by.orderBy(F.lower("file_name"), "file_name")) - 1
    whole = images.select("directory", "file_name", at.alias("at"), F.count("*").over(by).alias("n"))
    first = F.greatest(F.lit(0), F.least(F.col("at") - (width // 2 - 1), F.col("n") - width))
    return whole.select("directory", "file_name", first.cast("long").alias("first"), F.least(first + width, F.col("n")).cast("long").alias("last"))


def history(prompts: DataFrame, size: int = 30) -> DataFrame:
    """(user_id, prompt, rank): every user's distinct prompts, latest first, as many as the history keeps."""
    once = prompts.groupBy("user_id", "prompt").agg(F.max("seq").alias("seq"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("seq").desc())) - 1
    return once.select("user_id", "prompt", rank.cast("long").alias("rank")).where(F.col("rank") < size)


def exemplars(tiles: DataFrame, boxes: DataFrame, k: int, rotate: int = 0, margin: float = 0.05) -> DataFrame:
    """(image_id, tile, ann_id, place): up to ``k`` boxes inside every tile by a margin.

    They are ordered by their centre's distance to the tile's centre, rotated by
    ``rotate``, with the tile's ``prefer`` first if it is inside, cut at k, and all but
    that one put in order of score.
    """
    shrunk = tiles.select("image_id", "tile", "prefer", *[(F.col(c) + (1 if c.endswith("0") else -1) * margin * (F.col(f"{c[0]}1") - F.col(f"{c[0]}0"))).alias(c) for c in ("x0", "y0", "x1", "y1")])
    held = range_join(shrunk, boxes.select("image_id", "ann_id", "score", "x0", "y0", "x1", "y1"), ["image_id"], within=1e-9)
    held = held.where("b_x0 >= a_x0 AND b_y0 >= a_y0 AND b_x1 <= a_x1 AND b_y1 <= a_y1")
    off = lambda a: F.col(f"a_{a}0") + F.col(f"a_{a}1") - F.col(f"b_{a}0") - F.col(f"b_{a}1")
    tile = W.partitionBy("image_id", "tile")
    near = held.select("image_id", F.col("a_tile").alias("tile"), F.col("b_ann_id").alias("ann_id"), F.col("b_score").alias("score"), (F.col("a_prefer") == F.col("b_ann_id")).alias("pinned"), (off("x") * off("x") + off("y") * off("y")).alias("far"))
    near = near.withColumn("at", F.row_number().over(tile.orderBy("far", "ann_id")) - 1).withColumn("n", F.count("*").over(tile))
    turned = near.withColumn("turn", F.pmod(F.col("at") - rotate, F.col("n"))).withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    first = turned.withColumn("pick", F.row_number().over(tile.orderBy(F.col("pinned").desc(), "turn"))).where(F.col("pick") <= k)
    place = F.row_number().over(tile.orderBy(F.col("pinned").desc(), F.col("score").desc(), "turn")) - 1
    return first.select("image_id", "tile", "ann_id", place.cast("long").alias("place"))


def tile_telemetry(detections: DataFrame, threshold: float, k: int = 32) -> DataFrame:
    """(image_id, tile, top, kept): per tile its k largest sigmoid scores, falling, and how many reach the threshold."""
    sigmoid = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    return detections.withColumn("p", sigmoid).groupBy("image_id", "tile").agg(
        F.slice(F.sort_array(F.collect_list(F.round("p", 6)), False), 1, k).alias("top"), F.count_if(F.col("p") >= threshold).alias("kept")
    )


def best_mask(candidates: DataFrame) -> DataFrame:
    """Per prompt the candidate mask of highest quality; ties go to the first."""
    return candidates.groupBy("image_id", "prompt").agg(F.max_by("ann_id", F.struct("quality", -F.col("ann_id"))).alias("ann_id"))


def worst_first(report: DataFrame, metric: str) -> DataFrame:
    """(category, rank) by rising metric, then name."""
    return report.select("category", metric, (F.row_number().over(W.orderBy(F.col(metric).asc_nulls_first(), "category")) - 1).cast("long").alias("rank"))  # a row per label


# ------------------------------------------------------------- label trees


def forest(categories: DataFrame, own: DataFrame, by_count: bool = True) -> DataFrame:
    """(path, name, id, depth, total): the label forest in display order.

    Roots are labels without parent and headings (id null) for unknown parents; siblings
    go by falling roll-up count then name, or by name.  A cycle is cut at its smallest
    name.  ``path`` sorts the rows: one (count, name) key per step from the root.
    """
    totals = roll_up(categories, own).select("name", "total")
    ids = categories.groupBy("name").agg(F.min("id").alias("id"), F.min_by(F.coalesce("supercategory", F.lit("")), "id").alias("parent"))
    headings = ids.where("parent <> ''").select(F.col("parent").alias("name")).distinct().join(ids, "name", "left_anti").select("name", F.lit(None).cast("int").alias("id"), F.lit("").alias("parent"))
    up = ancestors(categories)
    # a name on a cycle descends from itself; the smallest of the cycle is its root
    cycles = up.join(up.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("name"), F.lit(True).alias("back")).distinct(), ["name", "ancestor"])
    cut = cycles.groupBy("name").agg(F.min("ancestor").alias("least")).where("name < least").select("name", F.lit(True).alias("cut"))
    nodes = ids.join(cut, "name", "left").select("name", "id", F.when(F.col("cut"), F.lit("")).otherwise(F.col("parent")).alias("supercategory")).unionByName(headings.withColumnRenamed("parent", "supercategory"))
    key = F.struct((-F.col("total") if by_count else F.lit(0).cast("long")).alias("down"), F.lower("name").alias("low"), F.col("name").alias("name"))
    keyed = nodes.join(totals, "name", "left").fillna(0, ["total"]).withColumn("key", key)
    lines = ancestors(nodes.withColumn("id", F.coalesce("id", F.lit(0)))).join(keyed.select(F.col("name").alias("ancestor"), F.col("key").alias("k")), "ancestor")
    above = lines.groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "k"))).alias("above"))
    out = keyed.join(above, "name", "left").withColumn("path", F.concat(F.coalesce(F.transform("above", lambda x: x["k"]), F.expr("cast(array() as array<struct<down: bigint, low: string, name: string>>)")), F.array("key")))
    return out.select("path", "name", "id", (F.size("path") - 1).cast("long").alias("depth"), "total")


def subtree(categories: DataFrame, name: str) -> DataFrame:
    """(name): the label and all below it."""
    below = ancestors(categories).where(F.col("ancestor") == name).select("name")
    return categories.where(F.col("name") == name).select("name").unionByName(below).distinct()


def parent_options(categories: DataFrame, name: str) -> DataFrame:
    """Labels and headings that may become the parent of a label: none of its own subtree."""
    every = categories.select("name").unionByName(categories.where("supercategory <> ''").select(F.col("supercategory").alias("name"))).distinct()
    return every.join(subtree(categories, name), "name", "left_anti")


# ------------------------------------------------------------- names as sets


def name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): new, vanished or kept names, and those that occur more than once."""
    count = lambda side, n: side.groupBy("name").agg(F.count("*").alias(n))
    both = count(before, "b").join(count(after, "a"), "name", "full")
    change = F.when(F.col("a") > 1, "duplicate").when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "vanished").otherwise("kept")
    return both.select("name", change.alias("change"))


def common_categories(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Categories of both sides in the reference's order."""
    return ref.join(pred.select("name").distinct(), "name", "left_semi").select("name", (F.row_number().over(W.orderBy("id")) - 1).cast("long").alias("position"))  # a row per label


def holds_all(wanted: DataFrame, held: DataFrame, key: str) -> bool:
    """Whether every wanted key is held."""
    return wanted.join(held, key, "left_anti").isEmpty()


# ------------------------------------------------------------- figures


def bin_range(histogram: DataFrame) -> DataFrame:
    """(first, last): the bins that any label occupies."""
    return histogram.where("n > 0").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))


def time_left(progress: DataFrame) -> DataFrame:
    """Seconds left per job from the pace of tiles and images and the counts to go; null before any pace is known."""
    tiles = F.col("tiles_total") - F.col("tiles_done")
    images = F.col("images_total") - F.col("images_done") - 1
    own = F.col("tile_pace") * tiles
    return progress.select("*", F.round(own, 3).alias("image_left"), F.round(F.coalesce(own, F.lit(0.0)) + F.col("image_pace") * F.greatest(images, F.lit(0)), 3).alias("all_left"))


def packed_forwards(clusters: DataFrame, k: int) -> DataFrame:
    """(image_id, forwards): model runs for an image's clusters, k by k to a canvas."""
    return clusters.groupBy("image_id").agg(F.ceil(F.countDistinct("cluster") / (k * k)).alias("forwards"))


def cache_figures(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: hits, misses, hit rate, raw and stored bytes, and their ratio."""
    a = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    b = entries.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"))
    return a.join(F.broadcast(b)).select("*", G.ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"), G.ratio(F.col("raw_bytes"), F.col("stored_bytes")).alias("compression"))  # one row each


def eviction_plan(files: DataFrame, budget: int, headroom: int, current: int) -> DataFrame:
    """(source, bytes, evict): least recently used sources go until the rest fit budget less headroom; the current one stays.

    Sources are ranked by their newest file.  The running sum runs over sources, a row
    each, not over files.
    """
    sources = files.groupBy("source").agg(F.max("modified").alias("used"), F.sum("bytes").alias("bytes"))
    older = F.sum(F.when(F.col("source") != current, F.col("bytes")).otherwise(0)).over(W.orderBy("used", "source").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("bytes").over(W.partitionBy())
    over = total - F.coalesce(older, F.lit(0)) > budget - headroom
    return sources.select("source", "bytes", ((F.col("source") != current) & over).alias("evict"))


def dashboard(report: DataFrame, ref: DataFrame, pred: DataFrame, images: DataFrame) -> DataFrame:
    """Per image its file, how many reference and predicted masks and categories it has, and its F1; images without any stay."""
    count = lambda side, name: side.groupBy("image_id").agg(F.count("*").alias(name), F.collect_set("category").alias(f"{name}_cats"))
    out = images.select(F.col("id").alias("image_id"), "file_name").join(count(ref, "n_ref"), "image_id", "left").join(count(pred, "n_pred"), "image_id", "left")
    none = F.array().cast("array<string>")
    cats = F.size(F.array_union(F.coalesce("n_ref_cats", none), F.coalesce("n_pred_cats", none)))
    scored = report.select("image_id", "f1")
    return out.join(scored, "image_id", "left").select("file_name", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), cats.cast("long").alias("categories"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def directory_counts(listing: DataFrame, ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Listed files with the masks that both sides have for them; names compare by base name in lower case."""
    key = lambda c: F.lower(base_name(F.col(c)))
    count = lambda side, name: side.groupBy(key("file_name").alias("k")).agg(F.count("*").alias(name))
    out = listing.withColumn("k", key("file_name")).join(count(ref, "n_ref"), "k", "left").join(count(pred, "n_pred"), "k", "left")
    return out.select("file_name", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


# ------------------------------------------------------------- knobs of a form


def lenient_number(text: Column, default: float, low: float, high: float, whole: bool = False) -> Column:
    """A typed number, or the default where the text is blank, no number or out of range."""
    value = F.trim(text).try_cast("double")
    good = F.coalesce(value.between(low, high), F.lit(False))
    if whole:
        good = good & (value == F.floor(value))
    return F.when(good, value).otherwise(F.lit(float(default)))


def group_response(groups: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seed, members, box): groups of two or more carry the union's bounds with two places, single ones null."""
    held = groups.join(boxes.select(*keys, "ann_id", "x0", "y0", "x1", "y1"), [*keys, "ann_id"])
    bounds = [f(c).alias(c) for c, f in zip(("x0", "y0", "x1", "y1"), (F.min, F.min, F.max, F.max), strict=True)]
    out = held.groupBy(*keys, "seed").agg(F.array_sort(F.collect_list("ann_id")).alias("members"), *bounds)
    several = F.size("members") > 1
    return out.select(*keys, "seed", "members", *[F.when(several, G.places(F.col(c).cast("double"), 2)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def stale_generation(events: DataFrame, current: Mapping[str, int] | DataFrame) -> DataFrame:
    """Events of the generation that is current for their image; late and foreign ones go.  ``current``: image_id, generation."""
    return events.join(current, ["image_id", "generation"], "left_semi")
