"""Kernels against independent NumPy or pure-Python versions, and properties."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.functions import raster
from tilewright.operators import embed, select, stats


def picks_by_definition(ids, x, y, base, terms, features=None, vectors=None, cluster=None, rep=None, eligible=None, reserve=None, regions=None):
    """Every term worked out again from the list of picks."""
    n = len(ids)
    features = np.zeros((n, 0)) if features is None else features

    def score(i, chosen):
        near = max((math.exp(-math.hypot(x[i] - x[j], y[i] - y[j]) / terms.scale) for j in chosen), default=0.0)
        div = min((math.sqrt(((features[i] - features[j]) ** 2).mean()) for j in chosen), default=0.0) if features.shape[1] else 0.0
        red = 1 - min(1.0, div) if chosen else 0.0
        sim = max((float(vectors[i] @ vectors[j]) for j in chosen), default=0.0) if vectors is not None else 0.0
        nov = (1 - sim if chosen else 0.0) if vectors is not None else 0.0
        held = sum(cluster[j] == cluster[i] for j in chosen) if cluster is not None else len(chosen)
        s = base[i] - terms.spatial * near - terms.redundancy * red + terms.diversity * div + terms.embedding * nov - terms.similarity * max(0.0, sim)
        return s + terms.cluster / (1 + held) + terms.representative * (rep[i] if rep is not None else 0.0)

    chosen, open_ = [], [i for i in range(n) if eligible is None or eligible[i]]

    def take(pool):
        if not pool:
            return False
        best = min(pool, key=lambda i: (-score(i, chosen), ids[i]))
        chosen.append(best)
        open_.remove(best)
        return True

    if terms.round_robin:
        names, turn, idle = sorted({regions[i] for i in open_}), 0, 0
        while names and len(chosen) < terms.k and idle < len(names):
            idle = 0 if take([i for i in open_ if regions[i] == names[turn % len(names)]]) else idle + 1
            turn += 1
        open_ = [i for i in range(n) if reserve[i] and i not in chosen] if terms.fill else []
    while len(chosen) < terms.k and take(list(open_)):
        pass
    return chosen


@pytest.mark.parametrize("seed", range(6))
def test_incremental_picks_equal_definition(seed):
    r = np.random.default_rng(seed)
    n = 60
    x, y, base = r.integers(0, 20, n) * 1024.0, r.integers(0, 20, n) * 1024.0, r.random(n)
    features, v = r.random((n, 4)), r.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cluster, rep = r.integers(0, 5, n), r.random(n)
    eligible, regions = r.random(n) < 0.5, np.array([f"r{i % 3}_c{i % 5}" for i in range(n)])
    reserve = np.ones(n, bool)
    terms = select.Terms(k=16, diversity=0.2, redundancy=0.1, embedding=0.2, similarity=0.15, cluster=0.1, representative=0.1, round_robin=seed % 2 == 0, fill=seed % 4 == 0)
    p = select.Picks(base, x, y, terms, features, v, cluster, rep)
    got = [i for i, *_ in select.run_picks(np.arange(n), eligible, reserve, regions, p)]
    assert got == picks_by_definition(list(range(n)), x, y, base, terms, features, v, cluster, rep, eligible, reserve, regions)


def test_picks_are_prefixes():
    r = np.random.default_rng(1)
    n = 50
    x, y, base = r.random(n) * 9000, r.random(n) * 9000, r.random(n)
    runs = []
    for k in (4, 9):
        p = select.Picks(base, x, y, select.Terms(k=k))
        runs.append([i for i, *_ in select.run_picks(np.arange(n), np.ones(n, bool), np.ones(n, bool), np.zeros(n), p)])
    assert runs[1][:4] == runs[0]


def test_shuffled_rank():
    order = list(range(37))
    random.Random(42).shuffle(order)
    rank = select.shuffled_rank(42, 37)
    assert [rank[i] for i in order] == list(range(37))


def test_terms_are_checked():
    for bad in ({"k": 0}, {"scale": 0.0}, {"spatial": -1.0}):
        with pytest.raises(ValueError):
            select.Terms(**bad)
    assert select.parse_grid(" 4X5 ") == (4, 5)
    with pytest.raises(ValueError):
        select.parse_grid("0x3")


def flood(mask):
    seen, sizes = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, n = [(y, x)], 0
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            n += 1
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        sizes.append(n)
    return sorted(sizes)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
def test_components(h, w, seed, p):
    mask = np.random.default_rng(seed).random((h, w)) < p
    assert sorted(raster.component_sizes(mask).tolist()) == flood(mask)


def test_raster_on_plain_tiles():
    white = raster.Tile(np.full((64, 64, 3), 255.0))
    f = raster.base_features(white) | raster.raster_features(white)
    assert f["tissue_ratio"] == 0 and f["visual_entropy"] == 0 and f["blur_score"] == 0
    assert f["artifact_penalty"] == pytest.approx(0.35 + 0.15 + 0.15)
    assert f["border_background_ratio"] == 1 and f["foreground_component_score"] == 0
    tissue = raster.Tile(np.broadcast_to(np.array([0.6, 0.2, 0.5]), (32, 32, 3)) * 255)
    f = raster.base_features(tissue) | raster.raster_features(tissue)
    assert f["tissue_ratio"] == 1 and f["foreground_component_score"] == 1 and f["gradient_energy_score"] == 0
    ramp = raster.Tile(np.repeat(np.linspace(0, 255, 64)[None, :, None], 64, 0).repeat(3, 2))
    assert raster.raster_features(ramp)["gradient_energy_score"] == pytest.approx(8 / 63)
    board = raster.Tile(np.repeat((np.indices((8, 8)).sum(0) % 2)[..., None], 3, 2) * 255.0)
    assert raster.raster_features(board)["glcm_contrast_proxy"] == 1.0


def test_resize():
    assert np.allclose(raster.triangle(np.full((64, 48), 7.0), 16, 12), 7.0)
    ramp = np.arange(64.0)[None].repeat(64, 0)
    assert np.allclose(np.diff(raster.triangle(ramp, 16, 16)[:, 2:-2], axis=1), 4.0)
    assert raster.nearest(np.arange(16).reshape(4, 4), 2, 2).tolist() == [[5, 7], [13, 15]]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_features_in_range(seed):
    t = raster.Tile(np.random.default_rng(seed).random((24, 20, 3)) * 255)
    for name, v in (raster.base_features(t) | raster.raster_features(t)).items():
        assert v >= 0 and (v <= 1 or name in ("pseudo_nuclear_component_count", "blur_score"))


def test_kmeans():
    r = np.random.default_rng(3)
    centres = np.eye(6)[:4] * 5
    v = np.concatenate([c + r.normal(size=(20, 6)) * 0.1 for c in centres])
    label, c = embed.kmeans_small(v, 4, 42)
    assert sorted(np.bincount(label).tolist()) == [20] * 4
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    assert len(set(embed.kmeans_small(v[:3], 8, 42)[0].tolist())) <= 3


def test_cosine_case(spark):
    rows = [(1, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])]
    pairs = embed.cosine_pairs(spark.createDataFrame(rows, "k int, i int, embedding array<double>"), "k", "i")
    d = [r["distance"] for r in pairs.collect()]
    assert sum(d) / 3 == pytest.approx(4 / 3)
    near = [r["nearest"] for r in embed.nearest(pairs.withColumnRenamed("i", "i"), "k").collect()]
    assert near == [pytest.approx(1.0)] * 3


def test_pool_hash_order(spark):
    rows = [("a", 10, 20, 1024), ("b", 30, 40, 1024)]
    schema = "candidate_id string, x_level0 long, y_level0 long, patch_size long"
    h = lambda r: stats.pool_hash(spark.createDataFrame(r, schema)).first()["pool_hash"]
    assert h(rows) == h(rows[::-1]) != h([rows[0], ("b", 31, 40, 1024)])
    assert stats.canonical_hash({"b": 1, "a": [1, 2]}) == stats.canonical_hash({"a": [1, 2], "b": 1})


def test_quota_equals_round_robin(spark):
    """With no sequential terms the window equals the kernel."""
    r = np.random.default_rng(5)
    n = 120
    pool = pd.DataFrame({"slide_id": 1, "candidate_id": [f"c{i:03d}" for i in range(n)], "x_level0": r.integers(0, 9, n) * 1024, "y_level0": r.integers(0, 9, n) * 1024, "patch_size": 1024, "score_raw": r.integers(0, 50, n) / 50, "slide_width": 9216, "slide_height": 9216})
    df = select.with_regions(spark.createDataFrame(pool))
    a = {(x["candidate_id"], x["rank"]) for x in select.quota_top(df, 16).collect()}
    b = {(x["candidate_id"], x["rank"]) for x in select.pick(df, select.Terms(k=16, spatial=0.0, round_robin=True)).where("selected").collect()}
    assert a == b
