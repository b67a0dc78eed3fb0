"""DuckDB statements that the queries of ``catalogue`` must equal."""

from __future__ import annotations

from tilewright.plans.fixtures import SQL as FX

_OUTCOMES = """,
fx_found AS (
  SELECT r.image_id, r.category, CASE WHEN m.pred IS NULL THEN 'fn' ELSE 'tp' END AS kind, m.pred, r.ann_id AS ref, m.iou, r.w * r.h AS area
  FROM fx_ref r LEFT JOIN fx_matches m ON m.image_id = r.image_id AND m.category = r.category AND m.ref = r.ann_id
  UNION ALL
  SELECT p.image_id, p.category, 'fp', p.ann_id, NULL, NULL, p.w * p.h FROM fx_pred p
  WHERE NOT EXISTS (SELECT 1 FROM fx_matches m WHERE m.image_id = p.image_id AND m.category = p.category AND m.pred = p.ann_id))
"""

_RATIO = "coalesce({a}::DOUBLE / nullif({b}, 0), 0)"


def _r(a: str, b: str) -> str:
    return _RATIO.format(a=a, b=f"({b})::DOUBLE")


_RUNS = """,
px AS (
  SELECT 'p' AS side, image_id, category, x, y0 AS a, least(y0 + h, 1000) AS b FROM (SELECT *, unnest(range(x0, least(x0 + w, 1000))) AS x FROM fx_pred)
  UNION ALL SELECT 'r', image_id, category, x, y0, y0 + h FROM (SELECT *, unnest(range(x0, x0 + w)) AS x FROM fx_ref)),
sides AS (SELECT side, image_id, category, x, a, max(b) AS b FROM (SELECT * FROM px UNION ALL SELECT 'u', image_id, category, x, a, b FROM px) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY side, image_id, category, x ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sides),
islands AS (SELECT *, sum(new) OVER (PARTITION BY side, image_id, category, x ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT side, image_id, category, max(b) - min(a) AS n FROM islands GROUP BY side, image_id, category, x, k),
areas AS (SELECT side, image_id, category, sum(n)::BIGINT AS area FROM spans GROUP BY side, image_id, category)
"""

_UNION_ONE = """,
cols AS (SELECT image_id, {extra} x, y0 AS a, max(y0 + h) AS b FROM (SELECT *, unnest(range(x0, x0 + w)) AS x FROM fx_ref) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY image_id, {extra} x ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM cols),
islands AS (SELECT *, sum(new) OVER (PARTITION BY image_id, {extra} x ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT image_id, {extra} max(b) - min(a) AS n FROM islands GROUP BY image_id, {extra} x, k)
"""

_TILES = """,
xs AS (SELECT id, width, height, CASE WHEN width <= 256 THEN [0] ELSE list_concat(range(0, width - 256, 192), [(width - 256)::BIGINT]) END AS xs,
              CASE WHEN height <= 256 THEN [0] ELSE list_concat(range(0, height - 256, 192), [(height - 256)::BIGINT]) END AS ys FROM fx_images),
cells AS (SELECT *, unnest(range(0, len(xs) * len(ys))) AS tile FROM xs),
tiles AS (
  SELECT id AS image_id, width, height, tile::INT AS tile, xs[tile % len(xs) + 1]::INT AS x0, ys[tile // len(xs) + 1]::INT AS y0,
         least(xs[tile % len(xs) + 1] + 256, width)::INT AS x1, least(ys[tile // len(xs) + 1] + 256, height)::INT AS y1 FROM cells),
cores AS (
  SELECT t.image_id, t.tile, any_value(t.width) AS width, any_value(t.height) AS height, any_value(t.x0) AS x0, any_value(t.y0) AS y0, any_value(t.x1) AS x1, any_value(t.y1) AS y1,
         greatest(any_value(t.x0), max(CASE WHEN o.x0 < t.x0 AND t.x0 < o.x1 THEN o.x1 END)) AS cx0, greatest(any_value(t.y0), max(CASE WHEN o.y0 < t.y0 AND t.y0 < o.y1 THEN o.y1 END)) AS cy0,
         least(any_value(t.x1), min(CASE WHEN o.x0 < t.x1 AND t.x1 < o.x1 THEN o.x0 END)) AS cx1, least(any_value(t.y1), min(CASE WHEN o.y0 < t.y1 AND t.y1 < o.y1 THEN o.y0 END)) AS cy1
  FROM tiles t LEFT JOIN tiles o ON o.image_id = t.image_id AND o.tile <> t.tile AND o.x0 < t.x1 AND t.x0 < o.x1 AND o.y0 < t.y1 AND t.y0 < o.y1
  GROUP BY t.image_id, t.tile)
"""

_CLIMB = """,
climb AS (
  SELECT name, supercategory AS ancestor, 1 AS depth FROM fx_categories WHERE supercategory <> ''
  UNION ALL
  SELECT c.name, p.supercategory, depth + 1 FROM climb c JOIN fx_categories p ON p.name = c.ancestor WHERE p.supercategory <> '' AND depth < 50)
"""

_SELF = """,
near AS (
  SELECT a.image_id, a.ann_id AS a_id, b.ann_id AS b_id, greatest(0, b.x0 - a.x0 - a.w, a.x0 - b.x0 - b.w, b.y0 - a.y0 - a.h, a.y0 - b.y0 - b.h)::BIGINT AS gap,
         a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h AS meets
  FROM fx_ref a JOIN fx_ref b ON a.image_id = b.image_id AND a.ann_id < b.ann_id)
"""

_SEEDS = """,
selfs AS (
  SELECT p.image_id, p.category, p.ann_id AS a, q.ann_id AS b,
         (least(p.x0 + p.w, q.x0 + q.w) - greatest(p.x0, q.x0)) * (least(p.y0 + p.h, q.y0 + q.h) - greatest(p.y0, q.y0)) AS inter, p.w * p.h AS pa, q.w * q.h AS qa
  FROM fx_pred p JOIN fx_pred q ON p.image_id = q.image_id AND p.category = q.category AND p.ann_id <> q.ann_id
   AND p.x0 < q.x0 + q.w AND q.x0 < p.x0 + p.w AND p.y0 < q.y0 + q.h AND q.y0 < p.y0 + p.h),
near AS (SELECT image_id, category, a, list(b) AS bs FROM selfs WHERE inter::DOUBLE / (pa + qa - inter) >= 0.3 GROUP BY image_id, category, a),
items AS (
  SELECT p.image_id, p.category, list([{'id': p.ann_id, 'seed': p.ann_id, 'near': coalesce(n.bs, [])}] ORDER BY p.score DESC, p.ann_id) AS v
  FROM fx_pred p LEFT JOIN near n ON n.image_id = p.image_id AND n.category = p.category AND n.a = p.ann_id GROUP BY p.image_id, p.category),
folded AS (
  SELECT image_id, category, list_reduce(list_concat([[{'id': -1::BIGINT, 'seed': -1::BIGINT, 'near': []::BIGINT[]}]], v), lambda acc, e:
    CASE WHEN list_contains(list_transform(acc, lambda x: x.id), e[1].id) THEN acc
    ELSE list_concat(acc, list_concat([{'id': e[1].id, 'seed': e[1].id, 'near': []::BIGINT[]}],
      list_transform(list_filter(e[1].near, lambda n: NOT list_contains(list_transform(acc, lambda y: y.id), n)), lambda m: {'id': m, 'seed': e[1].id, 'near': []::BIGINT[]}))) END) AS g
  FROM items)
"""

_SCENES = """,
sc AS (SELECT p.image_id, p.ann_id, p.score, p.x0::DOUBLE AS x0, p.y0::DOUBLE AS y0, least(p.x0 + p.w, i.width)::DOUBLE AS x1, least(p.y0 + p.h, i.height)::DOUBLE AS y1, i.width::DOUBLE AS width, i.height::DOUBLE AS height
  FROM fx_pred p JOIN fx_images i ON i.id = p.image_id WHERE p.x0 < i.width AND p.y0 < i.height)
"""

ORACLES: dict[str, str] = {
    "cluster_ambiguous": FX + _SCENES + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ann_id) - 1 AS rank FROM sc),
near AS (
  SELECT a.image_id, a.rank, list({'ranks': [b.rank], 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1} ORDER BY b.rank) AS near FROM rk a JOIN rk b ON a.image_id = b.image_id AND a.rank < b.rank
   AND greatest(b.x0 - a.x1, a.x0 - b.x1, b.y0 - a.y1, a.y0 - b.y1) <= 4 GROUP BY a.image_id, a.rank),
items AS (
  SELECT r.image_id, list({'rank': r.rank, 'seed': {'ranks': [r.rank], 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}, 'near': coalesce(n.near, []), 'groups': []::BIGINT[][]} ORDER BY r.rank) AS v,
         any_value({'rank': -1::BIGINT, 'seed': {'ranks': [r.rank], 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}, 'near': coalesce(n.near, []), 'groups': []::BIGINT[][]}) AS zero
  FROM rk r LEFT JOIN near n ON n.image_id = r.image_id AND n.rank = r.rank GROUP BY r.image_id),
folded AS (
  SELECT image_id, list_reduce(list_concat([zero], v), lambda acc, e: CASE WHEN list_contains(flatten(acc.groups), e.rank) THEN acc ELSE {'rank': acc.rank, 'seed': acc.seed, 'near': acc.near, 'groups': list_concat(acc.groups, [
    list_reduce(list_concat([e.seed], list_filter(e.near, lambda n: NOT list_contains(flatten(acc.groups), n.ranks[1]))), lambda h, n:
      CASE WHEN greatest(h.x1, n.x1) - least(h.x0, n.x0) <= 204.8 AND greatest(h.y1, n.y1) - least(h.y0, n.y0) <= 204.8
      THEN {'ranks': list_concat(h.ranks, n.ranks), 'x0': least(h.x0, n.x0), 'y0': least(h.y0, n.y0), 'x1': greatest(h.x1, n.x1), 'y1': greatest(h.y1, n.y1)} ELSE h END).ranks])} END).groups AS groups FROM items),
members AS (SELECT image_id, g, unnest(ranks) AS rank FROM (SELECT image_id, unnest(range(1, len(groups) + 1)) AS g, unnest(groups) AS ranks FROM folded)),
named AS (SELECT m.image_id, m.g, r.ann_id, min(r.ann_id) OVER (PARTITION BY m.image_id, m.g) AS lowest FROM members m JOIN rk r ON r.image_id = m.image_id AND r.rank = m.rank)
SELECT image_id, ann_id, dense_rank() OVER (PARTITION BY image_id ORDER BY lowest) - 1 AS cluster FROM named""",
    "exemplar_cover": FX + _SCENES + """,
t AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, least(greatest(round_even(greatest(x1 - x0, y1 - y0) / 0.25::DOUBLE, 0), 1), least(width, height)) AS side FROM sc),
p AS (SELECT *, greatest(0, least(round_even(cx - side / 2, 0), width - side)) AS tx, greatest(0, least(round_even(cy - side / 2, 0), height - side)) AS ty FROM t),
f AS (SELECT a.image_id, a.ann_id, any_value(a.cx) AS cx, any_value(a.cy) AS cy, any_value(a.tx) AS tx, any_value(a.ty) AS ty, any_value(a.side) AS side,
  count(*) FILTER (b.cx BETWEEN a.cx - a.side / 2 AND a.cx + a.side / 2 AND b.cy BETWEEN a.cy - a.side / 2 AND a.cy + a.side / 2) AS density,
  bool_or(b.x0 >= a.tx + a.side * 0.05::DOUBLE AND b.y0 >= a.ty + a.side * 0.05::DOUBLE AND b.x1 <= a.tx + a.side - a.side * 0.05::DOUBLE AND b.y1 <= a.ty + a.side - a.side * 0.05::DOUBLE) AS useful
  FROM p a JOIN p b ON a.image_id = b.image_id GROUP BY a.image_id, a.ann_id),
items AS (SELECT image_id, list({'cx': cx, 'cy': cy, 'tx': tx, 'ty': ty, 'side': side, 'tiles': []::STRUCT(tx DOUBLE, ty DOUBLE, side DOUBLE)[]} ORDER BY density DESC, ann_id) AS v FROM f WHERE useful GROUP BY image_id),
folded AS (
  SELECT image_id, list_reduce(list_concat([{'cx': -1::DOUBLE, 'cy': -1::DOUBLE, 'tx': 0::DOUBLE, 'ty': 0::DOUBLE, 'side': 0::DOUBLE, 'tiles': []::STRUCT(tx DOUBLE, ty DOUBLE, side DOUBLE)[]}], v), lambda acc, e:
    CASE WHEN len(list_filter(acc.tiles, lambda k: e.cx BETWEEN k.tx AND k.tx + k.side AND e.cy BETWEEN k.ty AND k.ty + k.side)) > 0 THEN acc
    ELSE {'cx': acc.cx, 'cy': acc.cy, 'tx': acc.tx, 'ty': acc.ty, 'side': acc.side, 'tiles': list_concat(acc.tiles, [{'tx': e.tx, 'ty': e.ty, 'side': e.side}])} END).tiles AS tiles FROM items)
SELECT image_id, shot, k.tx AS x0, k.ty AS y0, k.tx + k.side AS x1, k.ty + k.side AS y1 FROM (SELECT image_id, unnest(range(0, len(tiles))) AS shot, unnest(tiles) AS k FROM folded)""",
    "eval_matches": FX + "SELECT image_id, category, pred AS pred_id, ref AS ref_id, iou FROM fx_matches",
    "eval_outcomes": FX + _OUTCOMES + "SELECT image_id, category, kind, pred AS pred_id, ref AS ref_id, iou, area FROM fx_found",
    "eval_report_grouping_sets": FX + _OUTCOMES + f""",
sums AS (
  SELECT i.file_name, f.category, grouping(i.file_name, f.category)::BIGINT AS level, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn,
         coalesce(sum(round_even(iou * 1000000, 0)::BIGINT), 0)::DOUBLE / 1e6::DOUBLE AS s
  FROM fx_found f JOIN fx_images i ON i.id = f.image_id GROUP BY GROUPING SETS ((i.file_name, f.category), (f.category), ()))
SELECT file_name, category, level, tp, fp, fn, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('(2 * tp)', '2 * tp + fp + fn')} AS f1,
       {_r('s', 'tp')} AS sq, {_r('(2 * tp)', '2 * tp + fp + fn')} AS rq, {_r('s', 'tp')} * {_r('(2 * tp)', '2 * tp + fp + fn')} AS pq FROM sums""",
    "eval_image_scores": FX + _OUTCOMES + f""",
sums AS (SELECT image_id, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(DISTINCT category) AS categories FROM fx_found GROUP BY image_id)
SELECT *, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('(2 * tp)', '2 * tp + fp + fn')} AS f1 FROM sums""",
    "eval_bands": FX + _OUTCOMES + """,
banded AS (SELECT category, (area >= 64)::INT + (area >= 256)::INT + (area >= 1024)::INT + (area >= 4096)::INT + (area >= 16384)::INT AS band, kind = 'tp' AS hit FROM fx_found WHERE kind <> 'fp'),
spine AS (SELECT category, unnest(range(0, 6))::INT AS band FROM (SELECT DISTINCT category FROM fx_found))
SELECT s.category, s.band, ['0-8', '8-16', '16-32', '32-64', '64-128', '>=128'][s.band + 1] AS label, count(b.hit) AS total, count(*) FILTER (b.hit) AS hits,
       (count(*) FILTER (b.hit))::DOUBLE / nullif(count(b.hit), 0)::DOUBLE AS recall
FROM spine s LEFT JOIN banded b USING (category, band) GROUP BY s.category, s.band""",
    "eval_splits_merges": FX + """,
splits AS (SELECT category, count(*) AS n FROM (SELECT category, ref_id FROM fx_pairs WHERE 2 * inter >= pred_area GROUP BY category, ref_id HAVING count(*) >= 2) GROUP BY category),
merges AS (SELECT category, count(*) AS n FROM (SELECT category, pred_id FROM fx_pairs WHERE 2 * inter >= ref_area GROUP BY category, pred_id HAVING count(*) >= 2) GROUP BY category)
SELECT c.category, coalesce(s.n, 0) AS false_splits, coalesce(m.n, 0) AS false_merges FROM (SELECT DISTINCT category FROM fx_pairs) c LEFT JOIN splits s USING (category) LEFT JOIN merges m USING (category)""",
    "eval_semantic": FX + _RUNS + f""",
sums AS (SELECT category, coalesce(sum(area) FILTER (side = 'p'), 0)::BIGINT AS pred_px, coalesce(sum(area) FILTER (side = 'r'), 0)::BIGINT AS ref_px, coalesce(sum(area) FILTER (side = 'u'), 0)::BIGINT AS union_px FROM areas GROUP BY category)
SELECT *, pred_px + ref_px - union_px AS inter_px, {_r('(pred_px + ref_px - union_px)', 'union_px')} AS iou, {_r('(2 * (pred_px + ref_px - union_px))', 'pred_px + ref_px')} AS dice,
       {_r('(pred_px + ref_px - union_px)', 'pred_px')} AS precision, {_r('(pred_px + ref_px - union_px)', 'ref_px')} AS recall FROM sums""",
    "pair_iou": FX + "SELECT image_id, category, pred_id, ref_id, inter, iou FROM fx_iou",
    "mask_union_area": FX + _UNION_ONE.format(extra="category,") + "SELECT image_id, category, sum(n)::BIGINT AS area FROM spans GROUP BY image_id, category",
    "rle_roundtrip": FX + _UNION_ONE.format(extra="") + "SELECT image_id, sum(n)::BIGINT AS area FROM spans GROUP BY image_id",
    "mask_centroid": FX + """SELECT ann_id, ((least(x0 + w, 1000) - x0) * (least(y0 + h, 1000) - y0))::BIGINT AS area,
       (x0 + least(x0 + w, 1000))::DOUBLE / 2 AS cx, (y0 + least(y0 + h, 1000))::DOUBLE / 2 AS cy, x0, y0, least(x0 + w, 1000) AS x1, least(y0 + h, 1000) AS y1 FROM fx_pred""",
    "range_join_grid": FX + _SELF + "SELECT image_id, a_id, b_id FROM near WHERE meets",
    "bbox_gap_pairs": FX + _SELF + "SELECT image_id, a_id, b_id, gap FROM near WHERE gap <= 5",
    "neighbor_density": FX + """SELECT a.image_id, a.ann_id, count(*) AS neighbors FROM fx_ref a JOIN fx_ref b ON a.image_id = b.image_id
 AND abs(2 * b.x0 + b.w - 2 * a.x0 - a.w) <= greatest(a.w, a.h) AND abs(2 * b.y0 + b.h - 2 * a.y0 - a.h) <= greatest(a.w, a.h) GROUP BY a.image_id, a.ann_id""",
    "overlap_relation": FX + """SELECT image_id, category, pred_id AS new_id, ref_id AS accepted_id,
 CASE WHEN iou >= 0.5 THEN 'dup' WHEN inter::DOUBLE / pred_area >= 0.8 THEN 'dup' WHEN inter::DOUBLE / ref_area >= 0.8 THEN 'subsumes' ELSE 'none' END AS relation FROM fx_iou""",
    "smallest_under": FX + """SELECT p.image_id, p.ann_id AS point, arg_min(b.ann_id, (b.w * b.h, b.ann_id)) AS ann_id FROM fx_ref p JOIN fx_ref b ON b.image_id = p.image_id
 AND p.x0 + 5 BETWEEN b.x0 AND b.x0 + b.w AND p.y0 + 5 BETWEEN b.y0 AND b.y0 + b.h GROUP BY p.image_id, p.ann_id""",
    "tile_grid": FX + _TILES + "SELECT image_id, tile, x0, y0, x1, y1, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(x1 - x0, y1 - y0)) AS scale FROM tiles",
    "tile_cores": FX + _TILES + "SELECT image_id, tile, cx0, cy0, cx1, cy1 FROM cores",
    "core_classify": FX + _TILES + """,
seen AS (
  SELECT c.*, p.ann_id, greatest(p.x0, c.x0) AS a0, greatest(p.y0, c.y0) AS b0, least(p.x0 + p.w, c.x1) AS a1, least(p.y0 + p.h, c.y1) AS b1
  FROM fx_pred p JOIN cores c ON c.image_id = p.image_id AND p.x0 < c.x1 AND c.x0 < p.x0 + p.w AND p.y0 < c.y1 AND c.y0 < p.y0 + p.h)
SELECT image_id, tile, ann_id, a0 AS x0, b0 AS y0, a1 AS x1, b1 AS y1,
 (a0 > cx0 OR cx0 <= 0) AND (b0 > cy0 OR cy0 <= 0) AND (a1 < cx1 OR cx1 >= width) AND (b1 < cy1 OR cy1 >= height) AS clear FROM seen""",
    "pack_slots": FX + _TILES + "SELECT image_id, tile, (tile // 9)::BIGINT AS canvas, ((tile % 9 % 3) * 336)::BIGINT AS cell_x, ((tile % 9 // 3) * 336)::BIGINT AS cell_y FROM tiles",
    "dir_counts": FX + "SELECT i.file_name, n.category, coalesce(n.n, 0) AS n FROM fx_images i LEFT JOIN (SELECT image_id, category, count(*) AS n FROM fx_ref GROUP BY ALL) n ON n.image_id = i.id",
    "dir_area_histogram": FX + """,
b AS (SELECT *, least(greatest(length(bin(w * h)) - 5, 0), 19)::INT AS bin, w * h AS area FROM fx_ref),
e AS (SELECT category, min(area) AS min_area, max(area) AS max_area, min(w) AS min_w, max(w) AS max_w, min(h) AS min_h, max(h) AS max_h FROM b GROUP BY category)
SELECT category, bin, count(*) AS n, any_value(min_area) AS min_area, any_value(max_area) AS max_area, any_value(min_w) AS min_w, any_value(max_w) AS max_w, any_value(min_h) AS min_h, any_value(max_h) AS max_h
FROM b JOIN e USING (category) GROUP BY category, bin""",
    "category_totals": FX + "SELECT c.id, c.name AS category, count(r.ann_id) AS total, count(r.ann_id) FILTER (r.image_id = 7) AS here FROM fx_categories c LEFT JOIN fx_ref r ON r.category = c.name GROUP BY c.id, c.name",
    "label_rollup": FX + _CLIMB + """,
own AS (SELECT c.name, count(r.ann_id) AS own FROM fx_categories c LEFT JOIN fx_ref r ON r.category = c.name GROUP BY c.name),
spread AS (SELECT name, own FROM own UNION ALL SELECT ancestor, own FROM climb JOIN own USING (name))
SELECT s.name, coalesce(any_value(o.own), 0) AS own, sum(s.own)::BIGINT AS total FROM spread s LEFT JOIN own o USING (name) GROUP BY s.name""",
    "label_reroot": FX + _CLIMB + """SELECT c.id, c.name, CASE WHEN c.supercategory IN ('view', 'click')
 THEN coalesce((SELECT arg_min(ancestor, depth) FROM climb k WHERE k.name = c.name AND ancestor NOT IN ('view', 'click')), '') ELSE c.supercategory END AS supercategory FROM fx_categories c WHERE name NOT IN ('view', 'click')""",
    "drop_labels": FX + "SELECT r.ann_id, r.image_id, c.id AS category_id FROM fx_ref r JOIN fx_categories c ON c.name = r.category WHERE c.name <> 'click'",
    "merge_labels": FX + """,
mapped AS (SELECT CASE WHEN c.name IN ('click', 'signup') THEN 2 ELSE c.id END AS id, count(r.ann_id) AS n FROM fx_categories c LEFT JOIN fx_ref r ON r.category = c.name GROUP BY 1)
SELECT c.id, CASE WHEN c.id = 2 THEN 'touch' ELSE c.name END AS name, CASE WHEN c.id <> 2 AND c.supercategory IN ('click', 'signup') THEN 'touch' ELSE c.supercategory END AS supercategory, m.n
FROM fx_categories c JOIN mapped m ON m.id = c.id WHERE c.name <> 'signup'""",
    "save_append_ids": FX + """SELECT ann_id AS id, image_id, NULL::BIGINT AS ann_id FROM fx_ref WHERE ann_id % 10 <> 3
 UNION ALL SELECT (SELECT max(ann_id) FROM fx_ref WHERE ann_id % 10 <> 3) + row_number() OVER (ORDER BY ann_id), image_id, ann_id FROM fx_pred WHERE ann_id >= 100000000""",
    "stale_refs": FX + """SELECT r.ann_id, r.image_id FROM fx_ref r LEFT JOIN (SELECT * FROM fx_pred WHERE ann_id % 11 <> 4) p ON p.ann_id = r.ann_id
 WHERE p.ann_id IS NULL OR p.image_id <> r.image_id OR greatest(abs(p.x0 - r.x0), abs(p.y0 - r.y0), abs(p.w - r.w), abs(p.h - r.h)) > 1""",
    "upsert_latest": FX + "SELECT image_id, prompt, max(seq) AS seq, min(seq) AS position, arg_max(completed, seq) AS completed FROM fx_searches GROUP BY image_id, prompt",
    "upsert_replace": FX + """,
l AS (SELECT seq % 2 AS side, image_id, prompt, max(seq) AS seq, min(seq) AS position, arg_max(completed, seq) AS completed FROM fx_searches GROUP BY ALL)
SELECT l.image_id, l.prompt, l.seq, CASE WHEN l.side = 1 THEN coalesce(o.position, l.position) ELSE l.position END AS position, l.completed
FROM l LEFT JOIN l o ON l.side = 1 AND o.side = 0 AND o.image_id = l.image_id AND o.prompt = l.prompt
WHERE l.side = 1 OR NOT EXISTS (SELECT 1 FROM l n WHERE n.side = 1 AND n.image_id = l.image_id AND n.prompt = l.prompt)""",
    "neighbors_lag_lead": FX + """SELECT (id % 4)::BIGINT AS directory, file_name, (row_number() OVER w - 1)::INT AS position, lag(file_name) OVER w AS previous, lead(file_name) OVER w AS next
 FROM fx_images WINDOW w AS (PARTITION BY id % 4 ORDER BY lower(file_name), file_name)""",
    "top_rows_per_label": FX + """SELECT image_id, category, ann_id, rank, greatest(n - 5, 0) AS hidden FROM (
 SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, ann_id) AS rank, count(*) OVER (PARTITION BY image_id, category) AS n FROM fx_pred) WHERE rank <= 5""",
    "typical_sized": FX + """SELECT image_id, ann_id FROM (SELECT *, w * h AS a, count(*) OVER i AS n, sum(w * h) OVER i AS s, sum((w * h) * (w * h)) OVER i AS q FROM fx_ref WINDOW i AS (PARTITION BY image_id))
 WHERE (n * a - s) * (n * a - s) <= n * q - s * s""",
    "review_outliers": FX + """,
full_counts AS (SELECT i.id AS image_id, c.name AS category, count(r.ann_id) AS n FROM fx_images i CROSS JOIN fx_categories c LEFT JOIN fx_ref r ON r.image_id = i.id AND r.category = c.name GROUP BY ALL)
SELECT image_id, category, n, n = 0 OR (c * n - s) * (c * n - s) > 4 * (c * q - s * s) AS flag FROM (SELECT *, count(*) OVER l AS c, sum(n) OVER l AS s, sum(n * n) OVER l AS q FROM full_counts WINDOW l AS (PARTITION BY category))""",
    "tri_state_filter": FX + "SELECT image_id FROM fx_ref WHERE h > 60 GROUP BY image_id HAVING count(*) FILTER (category = 'view') > 0 AND count(*) FILTER (category = 'error') = 0",
    "dominant_label": FX + "SELECT image_id, arg_max(category, (n, -f)) AS category, max(n) AS n FROM (SELECT image_id, category, count(*) AS n, min(ann_id) AS f FROM fx_ref GROUP BY ALL) GROUP BY image_id",
    "ewma_pace": """SELECT user_id, CASE WHEN n = 1 THEN floor(raw * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE raw END AS pace FROM (SELECT user_id, list_reduce(list(value ORDER BY event_id) FILTER (value > 0),
  lambda a, x, i: floor((0.3::DOUBLE * x + 0.7::DOUBLE * CASE WHEN i = 2 THEN floor(a * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE a END) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE) AS raw,
  count(*) FILTER (value > 0) AS n FROM (SELECT user_id, event_id, value::DOUBLE AS value FROM events) GROUP BY user_id)""",
    "normalize_prompts": r"SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS prompt_sha256 FROM documents",
    "dedup_seed_groups": FX + _SEEDS + "SELECT image_id, category, m.id AS ann_id, m.seed AS seed FROM (SELECT image_id, category, unnest(g) AS m FROM folded) WHERE m.id >= 0",
    "retract_antijoin": "SELECT event_id, user_id, event_type FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.event_id - 1 = e.event_id)",
}
