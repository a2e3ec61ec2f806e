"""Whole queries without SQL against their definitions, and raster features against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import flood, picks_by_definition
from tilewright.functions import raster, score
from tilewright.operators import embed, segment, select
from tilewright.plans import registry, scans, selectors
from tilewright.sources import fixtures as fx
from tilewright.sources import slides as scan


def by_slide(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["slide_id"]].append(r)
    return out


@pytest.mark.parametrize("name", ["quota_greedy_topk", "quality_quota", "embed_quota", "gated_embed", "gated_from_slides"])
def test_picks_of_whole_queries(name, spark, sf, monkeypatch):
    """Every slide's picks, from the scored rows that the query hands to the kernel (their scores have SQL of their own)."""
    seen, real = [], select.pick

    def pick(df, terms, base="score_raw", by="slide_id", vectors=None):
        seen.append((df, terms, base, vectors))
        return real(df, terms, base, by, vectors)

    monkeypatch.setattr(select, "pick", pick)
    got = by_slide(registry.QUERIES[name](spark, sf).collect())
    df, terms, base, vectors = seen[0]
    slides = by_slide(df.collect())
    assert set(got) <= set(slides) and len(got) > 5
    for slide, rows in sorted(slides.items())[:6]:
        rows.sort(key=lambda r: r["candidate_id"])
        half = np.array([r["patch_size"] / 2 for r in rows])
        x, y = (np.array([r[c] for r in rows], float) + half for c in ("x_level0", "y_level0"))
        features = np.array([[r[f] or 0.0 for f in terms.fields] for r in rows], float) if terms.fields else None
        v = np.array([r[vectors] for r in rows], float) if vectors else None
        column = lambda c: [r[c] for r in rows] if c in df.columns else None
        cluster = column("cluster_id") if vectors else [0] * len(rows)
        eligible = [bool(e) for e in column("eligible")]
        reserve = [bool(e) for e in column("reserve")] if "reserve" in df.columns else eligible
        chosen = picks_by_definition([r["candidate_id"] for r in rows], x, y, [r[base] or 0.0 for r in rows], terms, features, v, cluster, column("representativeness") if vectors else None, eligible, reserve, column("region_id"))
        assert [r["candidate_id"] for r in sorted(got[slide], key=lambda r: r["rank"])] == [rows[i]["candidate_id"] for i in chosen], (name, slide)


def test_uniform_select(spark, sf):
    pool = by_slide(fx.candidates(spark, sf).collect())
    got = by_slide(registry.QUERIES["uniform_select"](spark, sf).collect())
    for slide, rows in pool.items():
        ids = sorted(r["candidate_id"] for r in rows)
        random.Random(42).shuffle(ids)
        assert [r["candidate_id"] for r in sorted(got[slide], key=lambda r: r["rank"])] == ids[:16]


def test_seeded_sample(spark, sf):
    pool = by_slide(fx.candidates(spark, sf).collect())
    got = by_slide(registry.QUERIES["seeded_sample"](spark, sf).collect())
    for slide, rows in pool.items():
        ids = sorted(r["candidate_id"] for r in rows)
        random.Random(42).shuffle(ids)
        assert sorted(r["candidate_id"] for r in got[slide]) == sorted(ids[:40])
    whole = fx.candidates(spark, sf)
    assert select.seeded_sample(whole, 0).count() == whole.count()
    assert select.seeded_sample(whole.where("false"), 5).count() == 0


def test_kmeans_fallback(spark, sf):
    pools = defaultdict(list)
    for r in fx.embeddings(spark, sf).collect():
        pools[r["vec_id"] // 50].append((r["candidate_id"], r["embedding"]))
    got = defaultdict(dict)
    for r in registry.QUERIES["kmeans_fallback"](spark, sf).collect():
        got[r["pool_id"]][r["candidate_id"]] = r["cluster_id"]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for pool, rows in sorted(pools.items())[:3]:
        rows.sort()
        v = [[x / math.sqrt(dot(e, e)) for x in e] for _, e in rows]
        k = min(8, len(v))
        chosen = [int(np.random.default_rng(42).integers(0, len(v)))]
        while len(chosen) < k:
            chosen.append(max((i for i in range(len(v)) if i not in chosen), key=lambda i: (min(1 - dot(v[i], v[j]) for j in chosen), -i)))
        centres = [v[i] for i in chosen]
        for _ in range(12):
            label = [min(range(k), key=lambda j: (1 - dot(x, centres[j]), j)) for x in v]
            for j in range(k):
                mine = [x for x, n in zip(v, label) if n == j]
                if mine:
                    mean = [sum(c) / len(mine) for c in zip(*mine)]
                    size = math.sqrt(dot(mean, mean))
                    centres[j] = [c / size for c in mean]
        assert [got[pool][i] for i, _ in rows] == label


def test_kmeans_of_equal_rows():
    label, _ = embed.kmeans_small(np.ones((7, 3)), 3, 1)
    assert len(label) == 7 and len(set(embed.farthest_first(np.ones((7, 3)) / math.sqrt(3), 3, 4).tolist())) == 3


def test_segment_selected(spark, sf):
    """Windows without overlap and a network that looks at single pixels: labels are those of the pixels themselves."""
    got = registry.QUERIES["segment_selected"](spark, sf).collect()
    assert got and {r["status"] for r in got} == {"completed"}

    class Wide(dict):
        def __missing__(self, key):
            return 40 * fx.TILE, 10**6

    reader = segment.SyntheticSlides(Wide())
    place = {(r["slide_id"], r["candidate_id"]): (r["x_level0"], r["y_level0"]) for r in fx.candidates(spark, sf).collect()}
    assert len(got) == 4 * len({s for s, _ in place})
    for r in got:
        pixels = reader.read(r["slide_id"], *place[r["slide_id"], r["candidate_id"]], 64, 64).mean(-1) / 255
        odds = np.stack([np.exp(-40 * (pixels - (c + 0.5) / 5) ** 2) for c in range(5)], -1)
        want = Counter(odds.argmax(-1).ravel().tolist())
        assert {int(e["key"]): e["value"] for e in r["class_pixel_counts"]} == dict(want) and r["prediction_shape"] == [64, 64]
        p = odds / odds.sum(-1, keepdims=True)
        assert r["mean_entropy"] == pytest.approx(float(np.mean(-(p * np.log(p)).sum(-1) / math.log(5))), abs=1e-5)


# Raster features that have no SQL, by loops.


def entropy_by_definition(values, bins):
    n = Counter(min(int(v * bins), bins - 1) for v in values)
    total = sum(n.values())
    return min(1.0, -sum(c / total * math.log2(c / total) for c in n.values()) / math.log2(bins)) if total else 0.0


def spread(values):
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def quantile(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low = int(at)
    return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])


def features_by_definition(t):
    h, w = t.grey.shape
    cut = lambda v: min(1.0, max(0.0, v))
    tissue = [(y, x) for y in range(h) for x in range(w) if t.tissue[y, x]]
    inside = tissue or [(y, x) for y in range(h) for x in range(w)]
    grey, stain, eosin = ([float(a[p]) for p in inside] for a in (t.grey, t.haematoxylin, t.eosin))
    reach = lambda v, scale: cut((quantile(v, 0.95) - quantile(v, 0.05)) / scale)
    contrast, hem, eos = reach(grey, 0.55), reach(stain, 1.2), reach(eosin, 1.2)
    step_y, step_x = max(1, h // 8), max(1, w // 8)
    blocks = [[(y, x) for y in range(top, min(h, top + step_y)) for x in range(left, min(w, left + step_x))] for top in range(0, h, step_y) for left in range(0, w, step_x)]
    sizes = flood(t.tissue)
    limit = max(quantile(stain, 0.7), sum(stain) / len(stain) + 0.25 * spread(stain))
    spots = np.array([[bool(t.tissue[y, x]) and t.haematoxylin[y, x] >= limit - 1e-12 for x in range(w)] for y in range(h)])
    parts = flood(spots)
    slope = bend = 0.0
    bends = []
    for y in range(h):
        for x in range(w):
            g = lambda y, x: float(t.grey[min(h - 1, max(0, y)), min(w - 1, max(0, x))])
            dx = (g(y, x + 1) - g(y, x - 1)) / (2 if 0 < x < w - 1 else 1)
            dy = (g(y + 1, x) - g(y - 1, x)) / (2 if 0 < y < h - 1 else 1)
            slope += dx * dx + dy * dy
            bends.append(g(y + 1, x) + g(y - 1, x) + g(y, x + 1) + g(y, x - 1) - 4 * g(y, x))
    sharp = (cut(80 * slope / (h * w)) + cut(80 * spread(bends) ** 2)) / 2
    return {
        "stain_balance_score": cut(1 - abs(hem - eos) / (hem + eos + 1e-6)),
        "low_contrast_penalty": cut(1 - contrast),
        "clean_tissue_ratio": len(tissue) / (h * w),
        "foreground_component_score": cut(0.75 * max(sizes) / sum(sizes) + 0.25 * (1 - min(1.0, (len(sizes) - 1) / 12))) if sizes else 0.0,
        "texture_entropy_score": entropy_by_definition(grey, 32),
        "local_entropy_score": sum(entropy_by_definition([float(t.grey[p]) for p in b], 16) for b in blocks) / len(blocks),
        "sharpness_quality_score": cut(sharp),
        "pseudo_nuclear_density_score": cut(4 * int(spots.sum()) / len(tissue)) if tissue else 0.0,
        "pseudo_nuclear_component_count": len(parts),
        "pseudo_nuclear_component_density": cut(len(parts) / max(1, len(tissue)) * 160),
        "pseudo_nuclear_size_variability": cut(spread(parts) / (sum(parts) / len(parts) + 1e-6)) if len(parts) > 1 else 0.0,
        "pseudo_nuclear_clustering_score": cut(4 * spread([sum(bool(spots[p]) for p in b) / len(b) for b in blocks])),
    }


@pytest.mark.parametrize("seed", range(8))
def test_raster_features_by_loops(seed):
    r = np.random.default_rng(seed)
    h, w = int(r.integers(9, 40)), int(r.integers(9, 40))
    a = r.integers(0, 256, (h, w, 3)).astype(float)
    if seed % 2:
        a[r.random((h, w)) < 0.6] = 255  # white ground
    if seed == 6:
        a[:] = 255
    t = raster.Tile(a)
    got = raster.raster_features(t)
    for name, want in features_by_definition(t).items():
        assert got[name] == pytest.approx(want, abs=1e-9), name


def test_multi_scale_entropy_by_loops():
    r = np.random.default_rng(3)
    grey = r.integers(0, 256, (16, 24)) / 255

    def small(a, n, m):
        out = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                ky = [max(0.0, 1 - abs(y + 0.5 - (i + 0.5) * a.shape[0] / n) * n / a.shape[0]) for y in range(a.shape[0])]
                kx = [max(0.0, 1 - abs(x + 0.5 - (j + 0.5) * a.shape[1] / m) * m / a.shape[1]) for x in range(a.shape[1])]
                out[i, j] = sum(ky[y] * kx[x] * a[y, x] for y in range(a.shape[0]) for x in range(a.shape[1])) / sum(ky) / sum(kx)
        return out

    whole = np.floor(grey * 255)
    want = [entropy_by_definition(grey.ravel().tolist(), 32)] + [entropy_by_definition((np.floor(small(whole, n, m) + 0.5) / 255).ravel().tolist(), 32) for n, m in ((8, 12), (4, 6))]
    assert raster.multi_scale_entropy(grey) == pytest.approx(sum(want) / 3, abs=1e-9)


def test_medical_scores_of_whole_query(spark, sf):
    got = {r["tile_id"]: r for r in registry.QUERIES["medical_scores"](spark, sf).collect()}
    features = {r["tile_id"]: r for r in raster.with_features(fx.tiles(spark, sf)).collect()}
    assert got.keys() == features.keys()
    for key, f in features.items():
        values = f.asDict() | {"tumor_bed_relevance_proxy": 0.0}
        for name, weights in score.COMPOSITE_WEIGHTS.items():
            total = sum(w * (1 - values[n[1:]] if n[0] == "~" else values[n]) for n, w in weights.items())
            values[name] = min(1.0, max(0.0, total))
            assert got[key][name] == pytest.approx(values[name], abs=2e-6)


# Pixels to selections.


def test_recomputed_features(spark, sf):
    got = registry.QUERIES["recomputed_features"](spark, sf).collect()
    reader = scan.PatternSlides()
    place = {(r["slide_id"], r["candidate_id"]): r for r in scans._pixel_pool(spark, sf).collect()}
    assert {r["method"] for r in got} == {"baseline", "smart"}
    for r in got[:60]:
        box = place[r["slide_id"], r["candidate_id"]]
        want = raster.base_features(raster.Tile(scan.read_padded(reader, r["slide_id"], box["x_level0"], box["y_level0"], 16, 16)))
        assert all(r[n] == pytest.approx(v, abs=2e-6) for n, v in want.items())


def test_scans_stream_and_fail_softly(spark):
    slides = spark.createDataFrame([(1,), (2,), (None,)], "slide_id long")

    class Broken(scan.PatternSlides):
        def size(self, slide_id):
            if slide_id == 2:
                raise OSError("truncated")
            return super().size(slide_id)

    got = {r["slide_id"]: r for r in scan.scan_headers(slides, Broken).collect()}
    assert got[1]["error"] is None and got[2]["error"] == "OSError: truncated" and got[2]["slide_width"] is None and got[None]["error"]
    boxes = spark.createDataFrame([(1, f"c{i}", i * 300, 0, 700) for i in range(12)], "slide_id long, candidate_id string, x_level0 long, y_level0 long, patch_size long")
    rows = scan.scan_regions(boxes, scan.PatternSlides, size=32).collect()
    assert len(rows) == 12 and all(len(r["rgb"]) == 32 * 32 * 3 and r["h"] == 32 for r in rows)
    spark.dataSource.register(scan.SlideSource)
    df = spark.read.format("slides").option("reader", "tilewright.sources.slides:PatternSlides").option("ids", "3, 7-9").load()
    assert sorted(r["slide_id"] for r in df.collect()) == [3, 7, 8, 9] and df.where("mpp_x is null").count() == 1
    with pytest.raises(ValueError):
        selectors.with_pixels(boxes, scan.PatternSlides, nuclear="x")
