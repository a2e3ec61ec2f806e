"""Queries on tables that are larger than their files look, or have longer numbers, than those of the other tests."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tilewright.functions import raster
from tilewright.operators import embed, gates, select
from tilewright.plans import registry, runs, scans, selection, selectors
from tilewright.sources import fixtures as fx
from tilewright.sources import slides as scan


@pytest.fixture(scope="module")
def late(sf, tmp_path_factory):
    """A folder whose parts are numbered beyond a million, where several share an id of six places, and its SQL."""
    d, c = str(tmp_path_factory.mktemp("late")), duckdb.connect()
    for name, far in (("supplier", "*"), ("lineitem", "* replace (l_partkey + 1000000 as l_partkey)")):
        c.execute(f"copy (select {far} from '{sf}/{name}.parquet') to '{os.path.join(d, name)}.parquet' (format parquet)")
        c.execute(f"create view {name} as select * from '{os.path.join(d, name)}.parquet'")
    return d, c


@pytest.mark.parametrize("name", ["candidates_filtered", "thumb_tissue_ratio", "offset_search"])
def test_generated_rows_are_not_broadcast(name, spark, sf):
    """A few slides or vectors make many rows, which Spark's estimates don't see."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["interpretation", "metric_table", "pool_key_set_equal", "region_clamped", "selected_stats", "untraceable_selected", "pool_multiset_equal", "recovered_ids", "region_context", "selection_overlap", "spatial_metrics"])
def test_parts_beyond_a_million(name, spark, late):
    assert_same(registry.QUERIES[name](spark, late[0]), late[1], registry.ORACLES[name])


@pytest.mark.parametrize("name", ["embed_quota", "gated_embed"])
def test_vectors_are_not_written_for_each_tile(name, spark, sf):
    """Only narrow rows are exchanged after the vectors have come to their tiles."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("FlatMapGroupsInPandas") : plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "SortMergeJoin" not in above


@pytest.mark.parametrize("name", ["embed_quota", "gated_embed"])
def test_tiles_are_grouped_where_their_slide_is(name, spark, sf):
    """Rows are dealt out by slide while they are narrow, and slides' extents come without the tiles."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan and not re.search(r"hashpartitioning\([^)]*l_partkey", plan)


def test_scored_tiles_are_dealt_out_once(spark, sf):
    plan = selection.scored(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not re.search(r"hashpartitioning\([^)]*l_partkey", plan)


def test_lengths_are_not_worked_out_for_each_component(spark, sf):
    plan = embed.centroids(embed.with_unit_vectors(fx.embeddings(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "size(transform" not in plan


def test_tiles_that_share_an_id_are_read_by_part(spark, late):
    """accept_until_k by its definition, with an order that is whole."""
    pool, want = {}, []
    for r in fx.candidates(spark, late[0]).collect():
        pool.setdefault(r["slide_id"], []).append((r["candidate_id"], r["part"], r["tissue_ratio"] >= 0.7))
    for slide, rows in pool.items():
        n = {True: 0, False: 0}
        for name, _, ok in sorted(rows):
            if n[True] == 16:
                break
            want.append((slide, name, ok, n[ok]))
            n[ok] += 1
    got = [tuple(r) for r in registry.QUERIES["accept_until_k"](spark, late[0]).select("slide_id", "candidate_id", "accepted", "number").collect()]
    assert sorted(got) == sorted(want)


def test_rows_that_ties_leave_alone_equal_the_sql(spark, late):
    """accept_until_k: only rejected tiles that share the id of the 16th accepted one are there or not by an order that the SQL leaves open."""
    sure = "not exists (select 1 from {0} c where c.slide_id = x.slide_id and c.candidate_id = x.candidate_id and c.accepted and c.number = 15 and not x.accepted)"
    registry.QUERIES["accept_until_k"](spark, late[0]).createOrReplaceTempView("auk")
    got = spark.sql(f"select x.* from auk x where {sure.format('auk')}")
    # the SQL once, since its runs differ
    late[1].execute(f"create or replace table auk as {registry.ORACLES['accept_until_k']}")
    assert_same(got, late[1], f"select x.* from auk x where {sure.format('auk')}")
    assert 0 < got.count() <= spark.table("auk").count()


def test_small_tiles_are_measured_together(monkeypatch):
    """Stacks of tiles have the features that each has alone; only large and thin ones are measured alone."""
    rng, reader, alone = np.random.default_rng(5), scan.PatternSlides(), []
    tiles = [scan.read_padded(reader, i, int(rng.integers(9000)), int(rng.integers(7000)), 16, 16) for i in range(300)]
    for h, w in ((8, 8), (2, 2), (17, 23), (64, 64), (1, 5), (80, 72)):
        tiles += [np.full((h, w, 3), v, np.uint8) for v in (0, 128, 255)] + [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for _ in range(8)]
        tiles += [np.where(rng.random((h, w, 1)) < 0.5, 255, rng.integers(0, 256, (h, w, 3))).astype(np.uint8) for _ in range(8)]
    want = [raster.base_features(t) | raster.raster_features(t) for t in map(raster.Tile, tiles)]
    real = raster.Tile
    monkeypatch.setattr(raster, "Tile", lambda x: alone.append(x.shape) or real(x))
    got = raster.features_of(tiles)
    assert set(alone) == {(1, 5, 3), (80, 72, 3)} and list(got) == raster.ALL_FEATURES
    for f in raster.ALL_FEATURES:
        assert np.abs(got[f] - [r[f] for r in want]).max() < 1e-9, f
    assert all(len(x) == 0 for x in raster.features_of([]).values())


def test_bytes_are_summed_in_batches(spark, sf):
    cells = [b"", b"\x00\xff", None, b"", bytes(range(256)) * 50, b"\x07", None, b""]
    got = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cells)], "i int, rgb binary").coalesce(1).select("i", scans._total("rgb")).collect()
    assert dict(map(tuple, got)) == {i: None if c is None else sum(c) for i, c in enumerate(cells)}
    for name in ("region_context", "region_clamped"):
        assert "conv(" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_read_and_measured_in_one_pass(spark, sf):
    """No pixels go through the JVM, no vectors and no rows that can't be picked to the kernel; the picks are those of all rows."""
    plan = registry.QUERIES["gated_from_slides"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not re.search(r"\brgb#", plan)
    pool = scans._pixel_pool(spark, sf).where("slide_id % 4 = 0 and (slide_id > 4 or part % 19 = 0)")
    size = scan.scan_headers(scans._slides(spark, sf), scan.PatternSlides)
    args = runs._numbered(pool, fx.embeddings(spark, sf)), size, runs._vectors(spark, sf), scan.PatternSlides
    one, two = (selectors.gated_from_slides(*args, size=None, rest=rest, cap=60).where("selected") for rest in (False, True))
    rows_of = lambda p: sorted(map(tuple, p.select("slide_id", "rank", "candidate_id", *[F.round(c, 9) for c in ("score_final", *select.PARTS)]).collect()))
    assert rows_of(one) == rows_of(two) != []


def test_equal_tiles_are_measured_once(monkeypatch):
    reader, seen, real = scan.PatternSlides(), [], raster.features_of
    monkeypatch.setattr(raster, "features_of", lambda tiles: seen.extend(tiles) or real(tiles))
    monkeypatch.setattr(raster, "_memory", raster._Memory())
    rng = np.random.default_rng(8)
    ids, xs, ys = np.sort(rng.integers(0, 30, 900)), rng.integers(0, 8, 900) * 1024, rng.integers(0, 6, 900) * 1024
    tiles = [scan.read_padded(reader, i, x, y, 16, 16) for i, x, y in zip(ids.tolist(), xs.tolist(), ys.tolist())]
    want = np.array(list(real(tiles).values()))
    for _ in range(2):
        got = np.concatenate([raster.remembered(t) for t in scan.tiles_of(reader, ids, xs, ys, np.full(900, 16))], 1)
        assert np.abs(got - want).max() < 1e-9
    assert len(seen) == len({t.tobytes() for t in tiles}) < 900
    monkeypatch.setattr(raster, "MEMORY", 2000)  # starts again and again
    got = np.concatenate([raster.remembered(t) for t in scan.tiles_of(reader, ids, xs, ys, np.full(900, 16))], 1)
    assert np.abs(got - want).max() < 1e-9 and len(raster._memory.places) == 1 and raster._memory.used < 300


@pytest.mark.parametrize("many", [True, False])
@pytest.mark.parametrize("size", [None, 8])
def test_measured_boxes_are_the_regions_measured(many, size, spark):
    """Boxes beyond the slide, of other sizes and resized, with and without a reader of many."""

    class Plain:
        def __init__(self):
            self.size, self.read = scan.PatternSlides().size, scan.PatternSlides().read

    boxes = spark.createDataFrame([(i, x, y, n, f"{k}") for k, (i, x, y, n) in enumerate([(3, 0, 0, 16), (3, 511, 77, 16), (3, -5, 9, 16), (3, 40, 41, 8), (3, 60000, 0, 8), (5, 1, 2, 16), (5, 13, 5, 80), (5, 8, 3, 1), (3, 7, 7, 16)])], "slide_id long, x_level0 long, y_level0 long, patch_size long, name string")
    make = scan.PatternSlides if many else Plain
    want = {r["name"]: r for r in raster.with_features(scan.scan_regions(boxes, make, size=size)).collect()}
    got = scan.measured(boxes, make, size).collect()
    assert len(got) == len(want) == 9
    for r in got:
        assert all(abs(r[f] - want[r["name"]][f]) < 1e-9 for f in raster.ALL_FEATURES), r["name"]
        assert all(r[c] == want[r["name"]][c] for c in boxes.columns)


def test_gates_leave_out_only_rows_that_no_gate_lets_through(spark):
    rng, rows = np.random.default_rng(3), []
    for slide, n in enumerate([1, 5, 16, 40, 79, 80, 81, 200, 390, 400, 410, 600]):
        for copy in range(4):
            few = lambda: float(rng.integers(0, 6)) / 5 if copy == 1 else float(rng.random())
            rows += [(slide * 4 + copy, f"c{i:04}", None if copy == 3 and rng.random() < 0.1 else few(), None if copy == 2 and rng.random() < 0.2 else few(), few(), few() / 4) for i in range(n)]
    df = spark.createDataFrame(rows, "slide_id long, candidate_id string, score_v3_base double, medical_image_utility_score double, medical_image_quality_score double, medical_artifact_penalty double")
    eligible = lambda q: sorted(map(tuple, q.where("eligible").select("slide_id", "candidate_id", "eligibility_stage").collect()))
    for top_k in (None, 8, 40):
        want = eligible(gates.cascade(df, 16, top_k=top_k))
        assert eligible(gates.cascade(df, 16, top_k=top_k, rest=False)) == want and {r[2] for r in want} > {"all_scored_fallback"}
    assert gates.cascade(df, 16, rest=False).count() < len(rows) * 0.7


def test_equal_vectors_are_equally_alike():
    """Ties go to the smaller id only if rows that are equal have equal scores, to the bit, wherever they stand."""
    rng = np.random.default_rng(4)
    for n in range(2, 130, 7):
        v = np.repeat(rng.normal(size=(1, 64)), n, 0)
        p = select.Picks(np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), select.Terms(), None, np.concatenate([v, rng.normal(size=(1, 64))]))
        p.add(n)
        assert len(set(p.alike[:n].tolist())) == 1
