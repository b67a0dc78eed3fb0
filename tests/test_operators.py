"""Literal cases and brute-force counterparts of the operators that SQL does not express."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import dataset as D
from tilewright.operators import drawing as W
from tilewright.operators import review as V
from tilewright.operators import runs as R
from tilewright.operators import snapshots as N
from tilewright.operators import sweep as P
from tilewright.operators import tiling as L
from tilewright.operators import transactions as A
from tilewright.operators.matching import greedy_match
from tilewright.operators.spatial import range_join
from tilewright.sources import coco as C
from tilewright.sources import files as S
from tilewright.streaming import delivery as Y
from tilewright.streaming.events import commit_after_save, fold_directory


def test_counts_round_trip_and_refusals():
    rng = np.random.default_rng(5)
    for _ in range(40):
        h, w = rng.integers(1, 30, 2)
        mask = rng.random((h, w)) < rng.random()
        counts = R.counts_of(mask)
        assert R.checked_counts(R.encode_counts(counts), h, w) == counts
        assert (R.mask_of(counts, h, w) == mask).all()
    for bad in (b"", b"01", b"PPPPPPPPPPPP0", b"PPPPPPPPPPPPPP"):
        with pytest.raises(ValueError):
            R.checked_counts(bad, 8, 8)


def flood(mask):
    seen, out = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        out += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                seen[a, b] = out
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return seen


def test_despeckle_equals_flood_fill():
    rng = np.random.default_rng(6)
    for _ in range(25):
        mask = rng.random((24, 32)) < 0.6
        labels = flood(mask)
        sizes = np.bincount(labels.ravel())
        limit = 0.1 * sizes[1:].max()
        kept = mask & (sizes >= limit)[labels]
        holes = flood(~kept)
        rim = set(np.concatenate((holes[0], holes[-1], holes[:, 0], holes[:, -1])))
        small = np.bincount(holes.ravel())
        want = kept.copy()
        for k in range(1, holes.max() + 1):
            if k not in rim and small[k] < limit:
                want |= holes == k
        assert (R.despeckle(mask, 0.1) == want).all()


def test_splice_clips():
    out = R.splice(np.zeros((4, 5), bool), np.ones((3, 3), bool), 3, -1)
    assert out.sum() == 4 and out[:2, 3:].all()


def test_runs_tables_round_trip(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 3, 4), (1, 2, 2, 5, 10), (2, 9, 9, 12, 12)], "id long, x0 int, y0 int, x1 int, y1 int")
    runs = R.union_runs(R.box_runs(boxes, ["id"], 10), ["id"], 10)
    back = R.decode_runs(R.encode_runs(runs, "id", 10, 10), "id", 10, 10)
    area = lambda df: {r["id"]: r["a"] for r in df.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("a")).collect()}
    assert area(runs) == area(back) == {1: 12 + 24 - 2, 2: 1}


def test_cores_of_a_row_of_tiles(spark):
    images = spark.createDataFrame([(1, 80, 32)], "id long, width int, height int")
    tiles = L.grid(images, 32, 0.25)
    got = [(r.cx0, r.cy0, r.cx1, r.cy1) for r in L.cores(tiles).orderBy("tile").collect()]
    assert got == [(0, 0, 24, 32), (32, 0, 48, 32), (56, 0, 80, 32)]


def test_greedy_match_takes_best_first(spark):
    edges = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 10, 0.95), (1, 1, 20, 0.6), (1, 3, 30, 0.4)], "g int, pred long, ref long, iou double")
    assert {(r.pred, r.ref) for r in greedy_match(edges, ["g"]).collect()} == {(2, 10), (1, 20)}


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, x := rng.randint(-200, 400), y := rng.randint(-200, 400), x + rng.randint(1, 250), y + rng.randint(1, 90)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, k int, x0 int, y0 int, x1 int, y1 int")
    for within in (0, 7):
        got = sorted((r.a_id, r.b_id) for r in range_join(df, df, ["k"], cell=50, within=within).collect())
        gap = lambda a, b: max(b[2] - a[4], a[2] - b[4], b[3] - a[5], a[3] - b[5])
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (gap(a, b) < 0 if within == 0 else gap(a, b) <= within))
        assert got == want


def box_gap(a, b):
    return max(0, b[0] - a[2], a[0] - b[2], b[1] - a[3], a[1] - b[3])


def box_area(a):
    return max(0, a[2] - a[0]) * max(0, a[3] - a[1])


def meet(a, b):
    return box_area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def scenes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, width int, height int, ann_id long, x0 double, y0 double, x1 double, y1 double, score double")


def random_scene(rng, n, image=1, side=700):
    out = []
    for i in range(n):
        x, y = rng.randint(0, side - 70), rng.randint(0, side - 70)
        out.append((image, side, side, i, float(x), float(y), float(x + rng.randint(6, 70)), float(y + rng.randint(6, 70)), rng.randint(0, 99) / 100))
    return out


@pytest.mark.parametrize("by_score", [True, False])
def test_clusters_equal_a_scan_by_seeds(spark, by_score):
    rng = random.Random(9)
    rows = [r for image in range(6) for r in random_scene(rng, 30, image, 260)]
    got = {}
    for r in P.clusters(scenes(spark, rows), 90, 9, by_score).collect():
        got.setdefault((r.image_id, r.cluster), set()).add(r.ann_id)
    for image in range(6):
        own = [r for r in rows if r[0] == image]
        free, groups = sorted(own, key=(lambda r: (-r[8], r[3])) if by_score else (lambda r: ((r[6] - r[4]) * (r[7] - r[5]), r[3]))), []
        while free:
            seed, *others = free
            members, hull = [seed], seed[4:8]
            for r in others:
                wide = (min(hull[0], r[4]), min(hull[1], r[5]), max(hull[2], r[6]), max(hull[3], r[7]))
                if box_gap(seed[4:8], r[4:8]) <= 9 and wide[2] - wide[0] <= 90 and wide[3] - wide[1] <= 90:
                    members.append(r)
                    hull = wide
            groups.append({r[3] for r in members})
            free = [r for r in free if r not in members]
        assert [got[image, k] for k in range(len(groups))] == sorted(groups, key=min)


def test_knobs_name_all_faults():
    with pytest.raises(ValueError, match="tile, overlap, retries"):
        P.SweepParams(tile=0, overlap=2, retries=-1)
    with pytest.raises(TypeError, match="nonsense"):
        P.SweepParams.resolve(nonsense=1)


def test_sweep_joins_a_cut_object(spark):
    scene = scenes(spark, [(1, 320, 128, 0, 100.0, 40.0, 160.0, 70.0, 0.9), (1, 320, 128, 1, 20.0, 20.0, 40.0, 40.0, 0.8)])
    p = P.SweepParams(tile=128, overlap=0.25, min_tile=128)
    found = P.sweep(P._images(scene), P.box_detector(scene), p)
    assert {(r.x0, r.y0, r.x1, r.y1) for r in found["survivors"].collect()} == {(100.0, 40.0, 160.0, 70.0), (20.0, 20.0, 40.0, 40.0)}
    events = found["events"].orderBy("seq").collect()
    assert events[0].type == "start" and events[-1].type == "done" and events[-1].n == 2 and [e.seq for e in events] == list(range(len(events)))


def naive_relation(new, held, p):
    inter = meet(new, held)
    union = box_area(new) + box_area(held) - inter
    if (union and inter / union >= p.dup_iou) or inter / box_area(new) >= p.dup_ios:
        return "dup"
    return "subsumes" if inter / box_area(held) >= p.dup_ios else "none"


@pytest.mark.parametrize("novel", [False, True])
def test_resolution_equals_a_walk_in_order(spark, novel):
    """Candidates one after another against the pool and what stayed, with the covers of a repeat passed on."""
    rng = random.Random(4)
    p = P.SweepParams(novel=novel, gap=3.0)
    pool = [(1, f"1:0:{i}", *r[4:8]) for i, r in enumerate(random_scene(rng, 40, 1, 240))]
    cands = [(1, i, novel and rng.random() < 0.4, *r[4:8]) for i, r in enumerate(random_scene(rng, 60, 1, 240))]
    a = spark.createDataFrame(cands, "image_id long, ord long, aside boolean, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(pool, "image_id long, origin string, x0 double, y0 double, x1 double, y1 double")
    got = {r.ord: r.covers for r in P.resolve(a, b, p).collect()}
    want = {}
    for _, order, aside, *box in cands:
        near = lambda other: box_gap(box, other) <= p.gap  # noqa: B023, E731
        if any(naive_relation(box, held[2:], p) == "dup" or (aside and near(held[2:])) for held in pool if meet(box, held[2:]) or aside):
            continue
        covers = {held[1] for held in pool if meet(box, held[2:]) and naive_relation(box, held[2:], p) == "subsumes"}
        before = [k for k in want if (meet(box, cands[k][3:]) and naive_relation(box, cands[k][3:], p) == "dup") or (aside and near(cands[k][3:]))]
        if before:
            want[before[0]] |= covers
        else:
            want[order] = covers
    assert got == {k: sorted(v) for k, v in want.items()}


def test_backoff_tightens_until_a_blob_clears(spark):
    """A detector that sees one blob over two landed boxes on any tile wider than 150 pixels."""
    pool = spark.createDataFrame([(1, "1:0:0", 100.0, 100.0, 120.0, 120.0), (1, "1:0:1", 150.0, 100.0, 170.0, 120.0)], "image_id long, origin string, x0 double, y0 double, x1 double, y1 double")
    hulls = spark.createDataFrame([(1, 0, 90.0, 90.0, 180.0, 130.0, 20.0)], "image_id long, shot long, hx0 double, hy0 double, hx1 double, hy1 double, scale double")
    images = spark.createDataFrame([(1, 600, 600)], "id long, width int, height int")
    widths = []

    def detect(shots):
        widths.append(shots.select(F.col("x1") - F.col("x0")).first()[0])
        blob = F.col("x1") - F.col("x0") > 150
        box = lambda a, b: F.struct(F.lit(0).cast("long").alias("position"), *[F.when(blob, F.lit(u)).otherwise(F.lit(v)).alias(c) for c, u, v in zip(P.BOX, a, b, strict=True)], F.lit(0.9).alias("score"))
        return shots.select("image_id", "shot", F.explode(F.array(box((95.0, 95.0, 175.0, 125.0), (127.0, 100.0, 143.0, 120.0)))).alias("d")).select("image_id", "shot", "d.*")

    run = lambda retries: P.reprompt(hulls, images, pool, detect, P.SweepParams(retries=retries, min_tile=40, expand=2.0, step=0.75)).collect()
    assert run(0)[0].covers == ["1:0:0", "1:0:1"]
    widths.clear()
    kept = run(3)
    assert widths == [180.0, 135.0] and len(kept) == 1 and kept[0].covers == [] and kept[0].x0 == 127.0


def test_novel_detections_need_their_knob(spark):
    pool = spark.createDataFrame([(1, "1:0:0", 100.0, 100.0, 120.0, 120.0)], "image_id long, origin string, x0 double, y0 double, x1 double, y1 double")
    hulls = spark.createDataFrame([(1, 0, 130.0, 100.0, 150.0, 120.0, 20.0)], "image_id long, shot long, hx0 double, hy0 double, hx1 double, hy1 double, scale double")
    images = spark.createDataFrame([(1, 600, 600)], "id long, width int, height int")
    scene = scenes(spark, [(1, 600, 600, 0, 130.0, 100.0, 150.0, 120.0, 0.9), (1, 600, 600, 1, 180.0, 180.0, 200.0, 200.0, 0.8), (1, 600, 600, 2, 121.0, 121.0, 128.0, 128.0, 0.7)])
    run = lambda novel: sorted(r.x0 for r in P.reprompt(hulls, images, pool, P.box_detector(scene), P.SweepParams(novel=novel, gap=4.0)).collect())
    assert run(False) == [130.0] and run(True) == [130.0, 180.0]


def test_exemplar_tiles_equal_a_greedy_cover(spark):
    rng = random.Random(2)
    rows = random_scene(rng, 60, 1, 500)
    p = P.SweepParams(exemplar_frac=0.2)
    sizes = spark.createDataFrame([(1, 500, 500)], "image_id long, width int, height int")
    got = [(r.x0, r.y0, r.x1, r.y1) for r in P.exemplar_tiles(scenes(spark, rows).drop("width", "height"), sizes, p).orderBy("shot").collect()]
    boxes = [r[4:8] for r in rows]
    centre = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in boxes]
    side = [min(max(round(max(b[2] - b[0], b[3] - b[1]) / 0.2), 1), 500) for b in boxes]
    dense = [sum(abs(x - cx) <= s / 2 and abs(y - cy) <= s / 2 for x, y in centre) for (cx, cy), s in zip(centre, side, strict=True)]
    want = []
    for k in sorted(range(60), key=lambda k: (-dense[k], k)):
        x, y = (min(max(round(c - side[k] / 2), 0), 500 - side[k]) for c in centre[k])
        tile, m = (x, y, x + side[k], y + side[k]), 0.05 * side[k]
        inner = any(b[0] >= tile[0] + m and b[1] >= tile[1] + m and b[2] <= tile[2] - m and b[3] <= tile[3] - m for b in boxes)
        if inner and not any(t[0] <= centre[k][0] <= t[2] and t[1] <= centre[k][1] <= t[3] for t in want):
            want.append(tile)
    assert got == [tuple(map(float, t)) for t in want] and len(want) > 3


def test_equal_shots_count_once(spark):
    tiles = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 300.0, 300.0, 400.0, 400.0)], "image_id long, shot long, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([(1, 400, 400)], "image_id long, width int, height int")
    shots = P.exemplar_shots(tiles, sizes, P.SweepParams(scales=(1.0, 2.0), offsets=((0.0, 0.0), (-0.5, 0.0)))).orderBy("shot").collect()
    assert [(r.x0, r.x1) for r in shots] == [(0.0, 100.0), (0.0, 200.0), (300.0, 400.0), (250.0, 350.0), (200.0, 400.0)]


CATS = [(1, "cat", "pet"), (2, "dog", "pet"), (3, "pet", ""), (4, "pug", "dog"), (5, "a", "b"), (6, "b", "a")]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(CATS, "id long, name string, supercategory string"), spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 3)], "id long, category_id long")


def names(df):
    return {r["name"]: r["supercategory"] for r in df.collect()}


def test_drop_merge_parent(labels):
    cats, anns = labels
    kept, left = D.drop_labels(cats, anns, ["dog", "pet"])
    assert names(kept) == {"cat": "", "pug": "", "a": "b", "b": "a"} and {r.id for r in left.collect()} == {1, 3}
    merged, moved = D.merge_labels(cats, anns, ["cat", "dog"], "animal")
    assert names(merged)["pug"] == "animal" and names(merged)["animal"] == "pet"
    assert sorted(r.category_id for r in moved.collect()) == [1, 1, 3, 4]
    with pytest.raises(KeyError):
        D.drop_labels(cats, anns, ["fish"])
    with pytest.raises(ValueError):
        D.set_parent(cats, "pet", "pug")
    with pytest.raises(KeyError):
        D.set_parent(cats, "pug", "nowhere")
    with pytest.raises(ValueError):
        D.add_labels(cats, ["cat"])
    assert names(D.set_parent(cats, "pug", ""))["pug"] == ""


def test_roll_up_stops_at_cycles(labels):
    cats, anns = labels
    own = anns.join(cats, anns["category_id"] == cats["id"]).groupBy("name").agg(F.count("*").alias("n"))
    got = {r["name"]: (r["own"], r["total"]) for r in D.roll_up(cats, own).collect()}
    assert got["pet"] == (1, 4) and got["dog"] == (1, 2) and got["a"] == (0, 0)


def test_document_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 4, "height": 4}], "categories": [{"id": 1, "name": "x", "supercategory": ""}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "segmentation": {"size": [4, 4], "counts": "04<"}, "bbox": [0, 0, 1, 4], "area": 4, "iscrowd": 0},
                           {"id": 2, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 1, 1, 1, 0]], "bbox": [0, 0, 1, 1], "area": 1, "iscrowd": 0}]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    (tmp_path / "a.json").write_text("[]")
    assert C.is_dataset(json.dumps(doc)) and not C.is_dataset("{")
    path = C.find_dataset(spark, str(tmp_path))
    assert path.endswith("b.json")
    tables = C.read_dataset(spark, path)
    rows = tables["annotations"].orderBy("ord").collect()
    assert rows[0].rle.counts == "04<" and rows[1].rle is None
    C.write_document(tables, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["annotations"][0]["segmentation"]["size"] == [4, 4]
    with pytest.raises(ValueError):
        C.read_dataset(spark, str(tmp_path / "a.json"))


def test_listing_and_records(spark, tmp_path):
    for n in ("B.PNG", "a.jpg", "a_mask.tiff", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in C.list_images(spark, str(tmp_path)).collect()] == ["a.jpg", "B.PNG"]
    assert [r.name for r in C.list_images(spark, str(tmp_path), masks=True).collect()] == ["a_mask.tiff"]
    record = (3).to_bytes(4, "little") + b"\1" + (2).to_bytes(8, "little") + b"zz"
    assert C.read_records(record * 2 + record[:-1]) == [(3, 1, 13, 2), (3, 1, 28, 2)]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "image_id long, seq long, type string, index long, n long, origin string"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "e"))
    write([(1, 0, "start", None, 2, None), (1, 1, "batch", 0, 3, None), (2, 0, "batch", 0, 1, None)])
    fold_directory(spark, str(tmp_path / "e"), schema, str(tmp_path / "c"))
    write([(1, 2, "replace", 0, 1, "1:0:0"), (1, 3, "done", None, 3, None)])
    got = {r.image_id: (r.landed, r.retracted, r.done) for r in fold_directory(spark, str(tmp_path / "e"), schema, str(tmp_path / "c")).collect()}
    assert got == {1: (3, 1, True), 2: (1, 0, False)}  # the second run reads new events only, with the state of the first


def test_upsert_keeps_the_old_position(spark):
    rows = lambda *r: spark.createDataFrame(r, "k string, position long, v long")
    got = D.upsert(rows(("a", 0, 1), ("b", 1, 1)), rows(("b", 7, 2), ("c", 8, 2)), ["k"]).collect()
    assert sorted(got) == [("a", 0, 1), ("b", 1, 2), ("c", 8, 2)]


def test_stale_requests_change_nothing(spark):
    data = A.Dataset(
        spark.createDataFrame([(1, "a.png", 9, 9)], "id long, file_name string, width int, height int"),
        spark.createDataFrame([(1, "x", "")], "id long, name string, supercategory string"),
        spark.createDataFrame([(1, 1, 1, 0, 0, 4, 4), (2, 1, 1, 5, 5, 3, 3)], "ann_id long, image_id long, category_id long, x0 int, y0 int, w int, h int"),
    )
    refs = lambda *r: spark.createDataFrame(r, "ann_id long, image_id long, x0 int, y0 int, w int, h int")
    for bad in (refs((3, 1, 0, 0, 4, 4)), refs((1, 1, 0, 0, 4, 4), (2, 1, 5, 8, 3, 3))):
        with pytest.raises(A.Conflict):
            A.delete(data, bad)
    assert [r.ann_id for r in A.delete(data, refs((1, 1, 1, 0, 4, 4))).annotations.collect()] == [2]
    new = spark.createDataFrame([("y", 1, 1, 2, 2, 0), ("x", 2, 2, 2, 2, 1)], "category string, x0 int, y0 int, w int, h int, order int")
    after, counts = A.save(data, "b.png", 7, 7, refs((1, 1, 0, 0, 4, 4)), new)
    assert counts == {"new": 2, "deleted": 1} and sorted((r.ann_id, r.image_id, r.category_id) for r in after.annotations.collect()) == [(2, 1, 1), (3, 2, 2), (4, 2, 1)]
    with pytest.raises(ValueError):
        A.edit_labels(data, "rename", ["x"])


def test_drawing():
    blank = np.zeros((20, 30), bool)
    square = {"kind": "polygon", "points": [(2, 3), (12, 3), (12, 9), (2, 9)], "size": 1, "erase": False}
    mask = W.draw(blank, [square])
    assert mask.sum() == 60 and mask[3:9, 2:12].all()
    assert W.draw(mask, [square | {"erase": True}]).sum() == 0
    disc = W.draw(blank, [{"kind": "disc", "points": [(15.0, 10.0)], "size": 5.0, "erase": False}])
    want = {(y, x) for y in range(20) for x in range(30) if (x + 0.5 - 15) ** 2 + (y + 0.5 - 10) ** 2 <= 25}
    assert set(zip(*map(list, np.nonzero(disc)), strict=True)) == want
    line = W.draw(blank, [{"kind": "line", "points": [(5, 10), (25, 10)], "size": 4.0, "erase": False}])
    assert line[8:12, 5:25].all() and not line[:8].any() and line[9, 3] and not line[8, 3]
    bow = W.draw(blank, [{"kind": "polygon", "points": [(0, 0), (20, 0), (0, 20), (20, 20)], "size": 1, "erase": False}])
    assert not bow[10, 2] and bow[2, 10]
    assert W.parse_ops('[{"kind": "polygon", "points": [[0, 0], [1, 1]]}, {"kind": "disc", "points": [[1.234, 2]], "radius": 3}, {"kind": "line", "points": [[0, 0]]}, {"kind": "undo"}]') == [{"kind": "disc", "points": [(1.23, 2.0)], "size": 3.0, "erase": False}]
    with pytest.raises(ValueError):
        W.parse_ops('[{"kind": "spray"}]')


def test_erased_masks_are_refused(spark):
    masks = spark.createDataFrame([(1, bytearray(R.encode_counts([0, 4, 12]))), (2, bytearray(R.encode_counts([4, 4, 8])))], "ann_id long, counts binary")
    wipe = '[{"kind": "polygon", "erase": true, "points": [[0, 0], [1, 0], [1, 4], [0, 4]]}]'
    ops = lambda k: spark.createDataFrame([(k, wipe)], "ann_id long, ops string")
    with pytest.raises(ValueError, match="1"):
        W.update_masks(masks, ops(1), "ann_id", 4, 4)
    assert {r.ann_id: R.decode_counts(bytes(r.counts)) for r in W.update_masks(masks, ops(2), "ann_id", 4, 4).collect()} == {1: [0, 4, 12], 2: [4, 4, 8]}


def test_mask_distances_equal_pixel_distances(spark):
    rng = np.random.default_rng(3)
    rows, pixels = [], {}
    for k in range(14):
        x, y = rng.integers(0, 60, 2)
        parts = [(x, y, x + 6, y + 14), (x + 6, y + 8, x + 15, y + 14)]
        rows += [(1, k, *map(int, p)) for p in parts]
        pixels[k] = np.array([(a, b) for p in parts for a in range(p[0], p[2]) for b in range(p[1], p[3])])
    cells = N.snapshots(spark.createDataFrame(rows, "image_id long, ann_id long, x0 long, y0 long, x1 long, y1 long"), ["image_id", "ann_id"])
    for t in (0.5, 3, 7):
        far = lambda a, b: max(0, np.abs(pixels[a][:, None] - pixels[b][None]).max(2).min() - 1)
        assert {(r.a, r.b) for r in N.near_masks(cells, t).collect()} == {(a, b) for a in pixels for b in pixels if a < b and far(a, b) <= t}


def test_sizes_of_image_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\0" * 5
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + (0x0112).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (6).to_bytes(2, "little") + b"\0\0"
    frame = b"\xff\xc0" + (11).to_bytes(2, "big") + b"\x08" + (40).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\1\1\x11\0"
    jpeg = lambda turned: b"\xff\xd8" + (b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif if turned else b"") + frame
    for name, data in (("a.png", png), ("b.jpg", jpeg(False)), ("c.jpg", jpeg(True)), ("d.jpg", b"nothing")):
        (tmp_path / name).write_bytes(data)
    assert {r.name: (r.width, r.height) for r in S.image_sizes(spark, str(tmp_path)).collect()} == {"a.png": (7, 5), "b.jpg": (30, 40), "c.jpg": (40, 30), "d.jpg": (None, None)}


def test_paths_and_planes(spark, tmp_path):
    assert S.resolve_path("/data/", "a\\b/../c") == "/data/a/c"
    for bad in ("", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            S.resolve_path("/data", bad)
    body = bytes(range(200))
    assert S.join_planes(*S.split_planes(body)) == body
    (tmp_path / "two.json").write_text("{}")
    assert S.first_existing(spark, str(tmp_path), ["one.json", "two.json"]).endswith("two.json") and S.first_existing(spark, str(tmp_path), ["x"]) is None
    reads = []
    store = A.FileStore(spark, lambda p: reads.append(p) or len(reads))
    path = str(tmp_path / "two.json")
    assert store.get(path) == store.get(path) == 1
    (tmp_path / "two.json").write_text("{ }")
    assert store.get(path) == 2


def test_spill_and_index_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "g", 1, bytearray(b"ab")), ("s", "h", 2, bytearray(b"c"))], "source_key string, grid_key string, tile int, payload binary")
    S.append_spill(rows, str(tmp_path / "spill"))
    S.append_spill(rows.where("tile = 1"), str(tmp_path / "spill"))
    assert {(r.grid_key, r.entries, r.bytes) for r in S.spill_manifest(spark, str(tmp_path / "spill")).collect()} == {("g", 2, 4), ("h", 1, 1)}
    searches = spark.createDataFrame([("a.png", "cat", 1, 5, 5, True), ("a.png", "dog", 0, 5, 5, False)], "name string, prompt string, position long, width int, height int, completed boolean")
    A.write_searches(searches, str(tmp_path))
    doc = json.loads((tmp_path / "a.png.json").read_text())
    assert doc["version"] == A.INDEX_VERSION and [x["prompt"] for x in doc["searches"]] == ["dog", "cat"]
    assert [f.name for f in tmp_path.iterdir() if f.name.endswith(".tmp")] == []


def test_failing_streams_end_with_an_error():
    def events():
        yield {"type": "start"}
        raise RuntimeError("no model")

    assert [json.loads(x)["type"] for x in Y.encode_stream(events(), json.dumps)] == ["start", "error"]


def test_commit_after_save_records_only_what_is_saved(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    recorded = []

    def fail(batch, number):
        raise RuntimeError("disk full")

    with pytest.raises(Exception, match="disk full"):
        commit_after_save(stream(), fail, lambda b, n: recorded.append(n), str(tmp_path / "c")).awaitTermination()
    assert recorded == []
    commit_after_save(stream(), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), lambda b, n: recorded.append(b.count()), str(tmp_path / "c")).awaitTermination()
    assert recorded == [5] and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_directory_job_resumes(spark, tmp_path):
    seen = []
    run = lambda: Y.directory_job(spark, str(tmp_path / "q"), "id long", lambda b, n: seen.extend(r.id for r in b.collect()), str(tmp_path / "c")).awaitTermination()
    spark.range(3).write.parquet(str(tmp_path / "q"))
    run()
    spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "q"))
    run()
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_cycles_in_the_label_forest(labels):
    cats, anns = labels
    own = anns.join(cats, anns["category_id"] == cats["id"]).groupBy("name").agg(F.count("*").alias("n"))
    shown = [(r["name"], r["depth"]) for r in V.forest(cats, own).orderBy("path").collect()]
    assert shown == [("pet", 0), ("dog", 1), ("pug", 2), ("cat", 1), ("a", 0), ("b", 1)]


def test_outlines_are_the_frontier_and_shuffle_no_cells(spark, data):
    from tilewright.plans.catalogue_masks import snapshot_frontier

    rng = random.Random(8)
    rows = []
    for ann in range(40):
        x, top = rng.randrange(50), rng.randrange(50)
        for _ in range(rng.randrange(1, 5)):  # strips beside each other, with gaps; sides under, at and over a grid's
            y, w = top + rng.randrange(40), rng.choice((1, 3, 8, 32, 60))
            rows.append((ann % 3, ann, x, y, x + w, y + rng.choice((1, 5, 32, 70))))
            x += w + rng.choice((0, 0, 7))
    rects = spark.createDataFrame([*rows, (1, None, 0, 0, 5, 5)], "image_id long, ann_id long, x0 long, y0 long, x1 long, y1 long")
    keys = ["image_id", "ann_id"]
    want = N.frontier(N.snapshots(rects, keys), keys)
    got = N.outlines(rects, keys)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert N.outlines(rects, keys, 62).where("gw > 62").isEmpty()
    with pytest.raises(ValueError):
        N.outlines(rects, keys, 63)
    plan = snapshot_frontier(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "collect_set" not in plan  # of rectangles, and of counts per mask


def test_sweep_stops_after_the_step_asked_for(spark, data):
    from tilewright.plans.catalogue import _scenes

    scenes = _scenes(spark, data).where("image_id < 2")
    images, detect = P._images(scenes), P.box_detector(scenes)
    listed = lambda found: sorted(map(tuple, found["events"].select("image_id", "seq", "type", "index", "n", "origin").collect()), key=str)
    whole = listed(P.sweep(images, detect))
    for last, kinds in (("tiles", {"start", "batch"}), ("clusters", {"start", "batch", "regroup", "rebatch", "reprompt", "replace"})):
        assert listed(P.sweep(images, detect, last=last)) == [e for e in whole if e[2] in kinds]
    with pytest.raises(ValueError):
        P.sweep(images, detect, last="never")


def test_handed_over_steps_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    import time

    from tilewright.sources import tables

    gathered = []
    monkeypatch.setattr(tables, "_gathered", {})
    monkeypatch.setattr(tables.gc, "collect", lambda: gathered.append(1))
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    tables.give_back(spark)
    time.sleep(1)
    before = held()
    for k in range(3):
        tables.hand_over(spark.range(1000).groupBy((F.col("id") % (7 + k)).alias("k")).count(), "step")
    tables.give_back(spark, every=0)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before and len(gathered) >= 2


def test_a_finished_hand_over_frees_its_shuffle_at_once(spark, monkeypatch):
    """Without any later job: the listeners that still hold a write's plan have moved on when garbage is collected."""
    import time

    from tilewright.sources import tables

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    tables.give_back(spark, every=0)
    time.sleep(1)
    before = held()
    monkeypatch.setattr(tables, "_gathered", {})
    tables.hand_over(spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count(), "step")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before


def test_hand_overs_return_native_memory(spark, monkeypatch):
    from tilewright.sources import tables

    said = []
    monkeypatch.setattr(tables, "_gathered", {})
    monkeypatch.setattr(tables, "trim", lambda session, f=tables.trim: said.append(f(session)))
    assert tables.hand_over(spark.range(10), "step").count() == 10
    assert len(said) == 1 and (said[0] == "" or "native heap" in said[0])
