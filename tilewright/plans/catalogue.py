"""All queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import dataset as D
from tilewright.operators import evaluation as E
from tilewright.operators import runs as R
from tilewright.operators import spatial as S
from tilewright.operators import statistics as T
from tilewright.operators import sweep as P
from tilewright.operators import tiling as L
from tilewright.operators.matching import seeded_groups
from tilewright.plans import catalogue_masks, catalogue_review, catalogue_small, catalogue_sweep
from tilewright.plans import fixtures as X
from tilewright.plans.oracles import ORACLES
from tilewright.sources.coco import normalize_prompt
from tilewright.sources.tables import shared_folder
from tilewright.streaming.events import fold_directory

Query = Callable[[SparkSession, str], DataFrame]


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.corners(X.predicted(spark, d)), X.corners(X.reference(spark, d))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return E.outcomes(*_both(spark, d))


def _in_category_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.broadcast(X.categories(spark).select(F.col("id").cast("int").alias("category_id"), F.col("name").alias("category")))  # five rows
    return X.reference(spark, d).join(ids, "category").select("ann_id", "image_id", "category_id")


def eval_matches(spark, d):
    return E.matches(*_both(spark, d)).select("image_id", "category", F.col("pred").alias("pred_id"), F.col("ref").alias("ref_id"), "iou")


def pair_iou(spark, d):
    return E.pairs(*_both(spark, d)).select("image_id", "category", "pred_id", "ref_id", "inter", "iou")


def eval_outcomes(spark, d):
    return _found(spark, d).select("image_id", "category", "kind", F.col("pred").alias("pred_id"), F.col("ref").alias("ref_id"), "iou", "area")


def eval_report(spark, d):
    return E.report(_found(spark, d), X.images(spark, d))


def eval_image_scores(spark, d):
    return E.image_scores(_found(spark, d))


def eval_bands(spark, d):
    return E.band_recall(_found(spark, d))


def eval_splits_merges(spark, d):
    return E.splits_and_merges(E.pairs(*_both(spark, d)))


def eval_semantic(spark, d):
    return E.semantic(*_both(spark, d), X.FRAME)


def mask_union_area(spark, d):
    return R.strip_union_area(R.box_strips(R.clip_boxes(_both(spark, d)[1], X.FRAME), E.GROUP), E.GROUP)


def mask_centroid(spark, d):
    return R.moments(R.box_runs(_both(spark, d)[0], ["ann_id"], X.FRAME), ["ann_id"], X.FRAME)


def range_join_grid(spark, d):
    ref = _both(spark, d)[1].drop("category")
    return S.range_join(ref, ref, ["image_id"]).where("a_ann_id < b_ann_id").select("image_id", F.col("a_ann_id").alias("a_id"), F.col("b_ann_id").alias("b_id"))


def bbox_gap_pairs(spark, d):
    ref = _both(spark, d)[1].drop("category")
    near = S.range_join(ref, ref, ["image_id"], within=5).where("a_ann_id < b_ann_id")
    return near.select("image_id", F.col("a_ann_id").alias("a_id"), F.col("b_ann_id").alias("b_id"), G.gap("a_", "b_").cast("long").alias("gap"))


def neighbor_density(spark, d):
    return S.neighbor_counts(_both(spark, d)[1], ["image_id"], "ann_id")


def overlap_relation(spark, d):
    pred, ref = _both(spark, d)
    return S.relation(S.range_join(pred.drop("score"), ref, E.GROUP)).select("image_id", "category", F.col("a_ann_id").alias("new_id"), F.col("b_ann_id").alias("accepted_id"), "relation")


def tile_grid(spark, d):
    return L.grid(X.images(spark, d))


def tile_cores(spark, d):
    return L.cores(L.grid(X.images(spark, d))).select("image_id", "tile", "cx0", "cy0", "cx1", "cy1")


def core_classify(spark, d):
    sized = X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    seen = L.detect_boxes(X.corners(X.predicted(spark, d)), L.grid(X.images(spark, d)))
    framed = seen.join(tile_cores(spark, d), ["image_id", "tile"]).join(sized, "image_id")
    return framed.select("image_id", "tile", "ann_id", "x0", "y0", "x1", "y1", L.unambiguous("", "c", F.col("width"), F.col("height")).alias("clear"))


def pack_slots(spark, d):
    return L.pack(tile_grid(spark, d).select("image_id", "tile"), "tile", 3, 1008)


def smallest_under(spark, d):
    points = X.reference(spark, d).select("image_id", F.col("ann_id").alias("point"), (F.col("x0") + 5).alias("px"), (F.col("y0") + 5).alias("py"))
    return S.smallest_under(points, _both(spark, d)[1], ["image_id"], "point")


def dir_counts(spark, d):
    return T.image_counts(X.images(spark, d), X.reference(spark, d))


def dir_area_histogram(spark, d):
    return T.area_histogram(X.reference(spark, d)).withColumn("bin", F.col("bin").cast("int"))


def category_totals(spark, d):
    return T.category_totals(X.categories(spark), X.reference(spark, d), 7)


def label_rollup(spark, d):
    own = X.reference(spark, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return D.roll_up(X.categories(spark), own)


def label_reroot(spark, d):
    return D.drop_labels(X.categories(spark), _in_category_ids(spark, d), ["view", "click"])[0]


def drop_labels(spark, d):
    return D.drop_labels(X.categories(spark), _in_category_ids(spark, d), ["click"])[1].select("ann_id", "image_id", "category_id")


def merge_labels(spark, d):
    cats, anns = D.merge_labels(X.categories(spark), _in_category_ids(spark, d), ["click", "signup"], "touch")
    return cats.join(anns.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", "name", "supercategory", F.coalesce("n", F.lit(0)).alias("n"))


def save_append_ids(spark, d):
    ref = X.reference(spark, d)
    old, new = ref.where("ann_id % 10 <> 3").select(F.col("ann_id").alias("id"), "image_id"), X.predicted(spark, d).where("ann_id >= 100000000").select("ann_id", "image_id")
    return D.append_rows(old, new, ["ann_id"]).select("id", "image_id", "ann_id")


def stale_refs(spark, d):
    return D.stale(X.reference(spark, d).drop("category"), X.predicted(spark, d).where("ann_id % 11 <> 4")).select("ann_id", "image_id")


def upsert_latest(spark, d):
    return D.latest(X.searches(spark, d), ["image_id", "prompt"], "seq")


def upsert_replace(spark, d):
    log = X.searches(spark, d)
    old, new = D.latest(log.where("seq % 2 = 0"), ["image_id", "prompt"], "seq"), D.latest(log.where("seq % 2 = 1"), ["image_id", "prompt"], "seq")
    return D.upsert(old, new, ["image_id", "prompt"])


def neighbors_lag_lead(spark, d):
    return T.neighbors(X.images(spark, d).withColumn("directory", (F.col("id") % 4).cast("long")))


def top_rows_per_label(spark, d):
    return T.top_rows(X.predicted(spark, d), ["image_id", "category"], 5).select("image_id", "category", "ann_id", F.col("rank").cast("long").alias("rank"), "hidden")


def typical_sized(spark, d):
    return T.typical_sized(X.reference(spark, d), ["image_id"]).select("image_id", "ann_id")


def review_outliers(spark, d):
    return T.outliers(X.images(spark, d), X.reference(spark, d), [n for _, n, _ in X.CATEGORIES])


def tri_state_filter(spark, d):
    counts = X.reference(spark, d).where("h > 60").groupBy("image_id", "category").agg(F.count("*").alias("n"))
    return T.tri_state(counts, ["view"], ["error"])


def dominant_label(spark, d):
    return T.dominant(X.reference(spark, d), ["image_id"])


def ewma_pace(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("value").cast("double").alias("value"))
    return T.pace(events, "user_id", "value", "event_id")


def normalize_prompts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(normalize_prompt(F.col("text")), 256).alias("prompt_sha256"))


def dedup_seed_groups(spark, d):
    pred = X.corners(X.predicted(spark, d))
    near = E.pairs(pred, pred.drop("score")).where("pred_id <> ref_id").select(*E.GROUP, F.col("pred_id").alias("a"), F.col("ref_id").alias("b"), "iou")
    return seeded_groups(pred, near, E.GROUP, 0.3).select("image_id", "category", "ann_id", "seed")


def retract_antijoin(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    gone = events.where("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id"))
    return D.live_events(events.where("event_type <> 'error'"), gone, ["event_id"])


def _scenes(spark, d):
    """Predicted boxes cut to their image's size; what lies outside has no pixel there."""
    sized = X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    held = X.corners(X.predicted(spark, d)).join(sized, "image_id").withColumn("x1", F.least("x1", "width")).withColumn("y1", F.least("y1", "height"))
    return held.where("x0 < x1 AND y0 < y1").select("image_id", "width", "height", "ann_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "score")


def sweep_events(spark, d):
    return P.run_sweeps(_scenes(spark, d))


def sweep_survivors(spark, d):
    return P.run_sweeps(_scenes(spark, d), survivors=True)


def cluster_ambiguous(spark, d):
    return P.clusters(_scenes(spark, d), 204.8, 4.0)


def exemplar_cover(spark, d):
    sizes = X.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    return P.exemplar_tiles(_scenes(spark, d).select("image_id", "ann_id", "x0", "y0", "x1", "y1"), sizes, P.SweepParams())


def rle_roundtrip(spark, d):
    runs = R.union_runs(R.box_runs(_both(spark, d)[1], ["image_id"], X.FRAME), ["image_id"], X.FRAME)
    return R.decode_runs(R.encode_runs(runs, "image_id", X.FRAME, X.FRAME), "image_id", X.FRAME, X.FRAME).groupBy("image_id").agg(F.sum(F.col("end") - F.col("start")).alias("area"))


def despeckle(spark, d):
    """Area of each image's union mask before and after clean-up."""
    import pandas as pd

    runs = R.union_runs(R.box_runs(_both(spark, d)[1], ["image_id"], X.FRAME), ["image_id"], X.FRAME)

    def clean(batches):
        for batch in batches:
            rows = []
            for image, raw in zip(batch["image_id"], batch["counts"], strict=True):
                mask = R.mask_of(R.checked_counts(bytes(raw), X.FRAME, X.FRAME), X.FRAME, X.FRAME)
                rows.append((image, int(mask.sum()), int(R.despeckle(mask).sum())))
            yield pd.DataFrame(rows, columns=["image_id", "area", "cleaned"])

    return R.encode_runs(runs, "image_id", X.FRAME, X.FRAME).mapInPandas(clean, "image_id long, area long, cleaned long")


def stream_fold(spark, d):
    """The sweep's events written as files and folded by a stream."""
    base = shared_folder(spark)
    sweep_events(spark, d).write.parquet(f"{base}/events")
    return fold_directory(spark, f"{base}/events", P.EVENTS, f"{base}/state")


def queries() -> dict[str, Query]:
    named = [
        eval_matches, eval_outcomes, eval_image_scores, eval_bands, eval_splits_merges, eval_semantic, pair_iou, mask_union_area, mask_centroid,
        range_join_grid, bbox_gap_pairs, neighbor_density, overlap_relation, smallest_under, tile_grid, tile_cores, core_classify, pack_slots,
        dir_counts, dir_area_histogram, category_totals, label_rollup, label_reroot, drop_labels, merge_labels, save_append_ids, stale_refs,
        upsert_latest, upsert_replace, neighbors_lag_lead, top_rows_per_label, typical_sized, review_outliers, tri_state_filter, dominant_label,
        ewma_pace, normalize_prompts, dedup_seed_groups, retract_antijoin, rle_roundtrip,
        sweep_events, sweep_survivors, cluster_ambiguous, exemplar_cover, despeckle, stream_fold,
    ]
    return {"eval_report_grouping_sets": eval_report} | {f.__name__: f for f in named} | catalogue_masks.QUERIES | catalogue_review.QUERIES | catalogue_sweep.QUERIES | catalogue_small.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | catalogue_masks.ORACLES | catalogue_review.ORACLES | catalogue_sweep.ORACLES | catalogue_small.ORACLES
