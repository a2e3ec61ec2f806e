"""Sources, sinks, parsing, segmentation, overlays, intake, selectors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import overlay, parse
from tilewright.operators import compare, embed, segment, stitch
from tilewright.plans import selectors
from tilewright.sources import fixtures, schemas, sinks, tables
from tilewright.streaming import intake


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_parsing(spark):
    cells = [(" 1.5 ",), ("abc",), ("",), (None,), ("NaN",), ("Infinity",), ("7",)]
    got = values(spark, cells, "c string", null=parse.number_or_null(F.col("c")), zero=parse.number_or(F.col("c")), whole=parse.integer_or(F.col("c"), -1))
    assert got == [(1.5, 1.5, -1), (None, 0.0, -1), (None, 0.0, -1), (None, 0.0, -1), (None, 0.0, -1), (None, 0.0, -1), (7.0, 7.0, 7)]
    assert values(spark, [("Yes ",), ("0",), ("TRUE",), ("n",)], "c string", t=parse.truth(F.col("c"))) == [(True,), (False,), (True,), (False,)]
    assert values(spark, [("", None, "x"), (" ", "", None)], "a string, b string, c string", f=parse.first_filled(F.col("a"), F.col("b"), F.col("c"))) == [("x",), (None,)]
    assert values(spark, [('{"0": 65, "1": "x"}',), ("bad",)], "c string", m=parse.json_counts(F.col("c")))[0] == ({"0": 65},)
    assert values(spark, [("['a', 'b']",), ('["c"]',), ("(1, 2)",)], "c string", m=parse.json_list(F.col("c"))) == [(["a", "b"],), (["c"],), (["1", "2"],)]
    assert values(spark, [(3.0, 2.0), (1.0, 0.0), (1.0, None)], "s double, b double", r=parse.relative_delta(F.col("s"), F.col("b"))) == [(0.5,), (None,), (None,)]
    assert values(spark, [("A-B-C-D-E.svs",)], "c string", i=parse.case_id(F.col("c")), s=parse.stem(F.col("c"))) == [("A-B-C", "A-B-C-D-E")]
    with pytest.raises(Exception, match="no case id"):
        values(spark, [("A-B",)], "c string", i=parse.case_id(F.col("c")))
    df = spark.createDataFrame([("10",), ("b",), ("2",), ("a",)], "k string")
    assert [r[0] for r in df.orderBy(*parse.class_order(F.col("k"))).collect()] == ["2", "10", "a", "b"]


def test_dominant_class(spark):
    got = values(spark, [({"1": 5, "3": 5, "0": 2},), ({},)], "m map<string,bigint>", d=compare.dominant_class(F.col("m")))
    assert got == [("3",), (None,)]


def test_recommendation(spark):
    rows = [(0.005, None, 0, False), (0.005, 1.2, 0, False), (0.5, 2.0, 0, True), (0.5, 4.0, 0, True), (0.02, 1.0, 0, False), (None, 1.0, 0, True), (0.1, 1.0, 3, True), (0.1, 1.0, None, True)]
    got = values(spark, rows, "a double, r double, u int, s boolean", c=compare.recommendation(F.col("a"), F.col("r"), F.col("u"), F.col("s")))
    assert [x[0] for x in got] == ["no_overlap", "similar", "overlap_aware", "inconclusive", "similar", "inconclusive", "no_overlap", "inconclusive"]


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "candidate_000001", None, True)], "slide_id long, candidate_id string, score_raw double, selected boolean")
    assert len(schemas.CANDIDATE) == len(set(schemas.CANDIDATE.names)) and "candidate_id" not in schemas.SELECTED.names
    sinks.csv_manifest(df, f"{tmp_path}/m", schemas.CANDIDATE)
    back = tables.csv_manifest(spark, f"{tmp_path}/m", schemas.CANDIDATE)
    assert back.columns == schemas.CANDIDATE.names
    assert back.select("slide_id", "candidate_id", "score_raw", "selected").first() == (1, "candidate_000001", None, True)
    with pytest.raises(Exception):
        sinks.csv_manifest(df, f"{tmp_path}/m", schemas.CANDIDATE)
    sinks.json_document({"b": 1, "a": [2]}, f"{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": [2], "b": 1} and len(list(tmp_path.glob("*.part"))) == 0
    with pytest.raises(FileExistsError):
        sinks.guarded(str(tmp_path))
    for bad in ("/", str(tmp_path / "keep")):
        with pytest.raises(ValueError):
            sinks.guarded(bad, True, (str(tmp_path / "keep"),))
    assert sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"), ["x", "y"]).splitlines()[-1] == "| a\\|b |  |"


def test_runs_and_pools(spark, tmp_path, sf):
    pool = fixtures.candidates(spark, sf)
    digest = sinks.shared_pool(pool, f"{tmp_path}/pool", "A-B-C")
    assert json.loads((tmp_path / "pool/pool.json").read_text())["pool_hash"] == digest
    with pytest.raises(FileNotFoundError):
        tables.load_run(spark, "x", str(tmp_path))
    run = tmp_path / "run"
    run.mkdir()
    for n in ("all_candidates.csv", "selected_patches.csv"):
        (run / n).write_text("candidate_id,rank\nc1,1\n")
    for n in ("selection_summary.json", "method_config.json"):
        (run / n).write_text('{"seed": 42}')
    got = tables.load_run(spark, "mine", str(run))
    assert got["selected"].first().asDict() == {"candidate_id": "c1", "rank": "1", "run": "mine"} and got["config"].first()["seed"] == 42
    (tmp_path / "a.svs").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert tables.slides_in(spark, str(tmp_path), 1).count() == 1
    with pytest.raises(ValueError):
        tables.slides_in(spark, str(tmp_path), 2)


def test_embedding_cache(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", 8, 8, rng.integers(0, 255, 192, dtype=np.uint8).tobytes()) for i in range(5)]
    tiles = spark.createDataFrame(rows, "candidate_id string, h int, w int, rgb binary")
    cache = spark.createDataFrame([("c1", [1.0] * 54)], "candidate_id string, embedding array<double>")
    got = {r[0]: r[1] for r in embed.embed_missing(tiles, cache, embed.ColourEmbedder()).collect()}
    assert len(got) == 5 and got["c1"] == [1.0] * 54
    meta = {"embedding_backend": "b", "embedding_model_name": "m", "embedding_distance_metric": "cosine"}
    placed = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "b", [1.0, 2.0])], "position int, candidate_id string, embedding array<double>")
    ids = placed.select("position", "candidate_id")
    assert embed.cache_fault(placed, ids, meta, meta, 2) is None
    assert "dimension" in embed.cache_fault(placed, ids, meta, meta, 3)
    assert "ids" in embed.cache_fault(placed, ids.where("position = 0"), meta, meta, 2)
    assert "model" in embed.cache_fault(placed, ids, meta, meta | {"embedding_model_name": "n"}, 2)
    first = sinks.embedding_cache(placed, f"{tmp_path}/c", meta, f"{tmp_path}/own")
    assert first == f"{tmp_path}/c" and sinks.embedding_cache(placed, f"{tmp_path}/c", meta, f"{tmp_path}/own") == f"{tmp_path}/own"


def test_segmentation(spark):
    reader, net = segment.SyntheticSlides({1: (200, 150)}), segment.BrightnessSegmenter(64, 32)
    box = segment.read_padded(reader, 1, -10, 140, 30, 20)
    assert (box[:, :10] == 255).all() and (box[10:] == 255).all() and (box[:10, 10:] == reader.read(1, 0, 140, 20, 10)).all()
    plain = segment.segment_tile(reader, net, 1, 32, 32, 64)
    assert sum(plain["counts"].values()) == 64 * 64 and plain["overlap"] == 0
    whole = segment.BrightnessSegmenter(128, 64)(segment.read_padded(reader, 1, 0, 0, 128, 128)).argmax(-1)
    assert (plain["label"] == whole).all()  # side-by-side windows put together what one window sees
    overlapped = segment.segment_tile(reader, net, 1, 32, 32, 64, stride=20, feathered=True)
    assert overlapped["overlap"] > 0.5 and (overlapped["label"] == whole).mean() > 0.99
    rows = [(1, "a", 0, 0), (2, "b", 0, 0), (1, None, None, 0)]
    df = spark.createDataFrame(rows, "slide_id long, candidate_id string, x_level0 long, y_level0 long")
    got = {r["candidate_id"]: r for r in segment.segment(df, lambda: segment.SyntheticSlides({1: (200, 150)}), lambda: segment.BrightnessSegmenter(64, 32), tile=64).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "completed", "b": "failed", None: "skipped"}
    assert sum(got["a"]["class_pixel_counts"].values()) == 64 * 64 and "KeyError" in got["b"]["error"]
    assert segment.label_mask(np.eye(4)[None]).shape == (4, 4)
    assert segment.label_mask(np.random.default_rng(0).random((5, 40, 40))).max() < 5
    with pytest.raises(ValueError):
        segment.label_mask(np.zeros((50, 60, 70)))


def test_split_then_stitch_is_identity(spark):
    r = np.random.default_rng(0).integers(0, 5, (16, 16))
    rows = [(1, q % 2 * 8, q // 2 * 8, y, x, int(r[q // 2 * 8 + y, q % 2 * 8 + x])) for q in range(4) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "k int, dx int, dy int, y int, x int, label int")
    assert {(a["y"], a["x"]): a["label"] for a in stitch.stitched(df, "k").collect()} == {(y, x): r[y, x] for y in range(16) for x in range(16)}
    with pytest.raises(ValueError):
        stitch.context_windows(df, 512, 1024)


def test_input_faults_and_metadata(spark):
    df = spark.createDataFrame([(1024, 1024, 3, 0, 250, 0.25), (512, 1024, 4, -1, 300, None), (1024, 1024, 3, 7, 7, 0.5)], "h int, w int, c int, lo int, hi int, mpp double")
    got = [r[0] for r in df.select(segment.input_faults(*[F.col(c) for c in ("h", "w", "c", "lo", "hi", "mpp")])).collect()]
    assert got[0] == [] and len(got[1]) == 4 and got[2] == ["constant tile", "resolution outside the tolerance"]
    rows = spark.createDataFrame([(1, "", "a")], "slide_id int, stain string, name string")
    summary = spark.createDataFrame([(1, "he")], "slide_id int, stain string")
    config = spark.createDataFrame([(1, "ihc", "x")], "slide_id int, stain string, lab string")
    m = segment.metadata(rows, summary, config, ["stain", "lab", "mpp"]).first()
    assert (m["stain"], m["lab"], m["mpp"], m["missing_fields"]) == ("he", "x", None, ["mpp"])


def test_overlays():
    labels = np.array([[0, 1], [8, 2]])
    assert tuple(overlay.colourised(labels)[1, 0]) == overlay.colour(0)
    rgb = np.full((2, 2, 3), 100, np.uint8)
    assert (overlay.overlaid(rgb, labels, 0.4, clear=(1,))[0, 1] == 100).all()
    assert overlay.masked_red(rgb, labels == 2, 0.5)[1, 1].tolist() == [178, 50, 50]
    assert overlay.stretched(np.array([[1.0, 3.0]])).tolist() == [[0, 255]] and overlay.stretched(np.ones((1, 2))).tolist() == [[0, 0]]
    assert overlay.side_by_side([rgb, rgb], 4).shape == (2, 8, 3)
    assert overlay.boxed(np.zeros((20, 20, 3), np.uint8), [(2, 2, 5, 5)]).any(-1).sum() == 16
    assert overlay.wrapped("one two three four", 8) == ["one two", "three…"] or overlay.wrapped("one two three four", 9)[0] == "one two"


def test_selectors(spark, sf):
    pool = fixtures.candidates(spark, sf)
    from tilewright.plans.selection import dims

    with pytest.raises(ValueError, match="unknown"):
        selectors.run("none", pool, dims(pool))
    with pytest.raises(ValueError, match="embeddings"):
        selectors.run("embed_quota", pool, dims(pool))
    with pytest.raises(ValueError):
        selectors.Config(k=0)
    for name in ("uniform", "greedy_spatial", "quota_diverse", "quality_quota"):
        rows = selectors.run(name, pool, dims(pool), k=5).where("selected").collect()
        by = {}
        for r in rows:
            by.setdefault(r["slide_id"], []).append(r["rank"])
        assert by and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in by.values()), name
    assert selectors.DEFAULTS["gated_embed"].document("gated_embed")["selector"] == "gated_embed"
    assert selectors.selected(selectors.run("greedy_spatial", pool, dims(pool), k=1), pool).first()["filename"].startswith("patch_0000_x")


def test_intake(spark, sf, tmp_path):
    pool = fixtures.candidates(spark, sf)
    from tilewright.plans.selection import dims

    pool.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = intake.case_stream(spark, f"{tmp_path}/in", pool.schema)
    q = intake.select_as_they_come(stream, dims(pool), f"{tmp_path}/out", f"{tmp_path}/check", k=3, cap=0)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("slide_id", "candidate_id", "rank").collect()
    want = selectors.run("greedy_spatial", pool, dims(pool), k=3, cap=0).where("selected").select("slide_id", "candidate_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    events = spark.createDataFrame([(1, "click", 2.0)], "t long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert intake.counts_by_window(events).first()["n"] == 1


def test_whole_comparisons(spark, sf):
    from tilewright.plans import comparison
    from tilewright.plans.selection import runs

    r = runs(spark, sf)
    a, b = (r.where(F.col("method") == m).drop("method") for m in ("baseline", "smart"))
    pool = fixtures.candidates(spark, sf)
    got = comparison.selections(a, b, pool, ({"seed": 1, "pool_hash": "x"}, {"seed": 2, "pool_hash": "y"}))
    assert got["warnings"] == ["seed differs: 1 and 2", "the pools differ"] and got["untraceable"].isEmpty()
    assert got["overlap"].count() == a.select("slide_id").distinct().count() and got["spatial"].count() > 0 and got["scores"].count() > 0
    with pytest.raises(ValueError):
        comparison.selections(a, b, pool.where("false"), strict=True)
    seg = comparison.segmentations(fixtures.segmentation(spark, sf))
    assert seg["classes"].count() == 5 and seg["status"].count() == 2


def test_caches_and_ordinals(spark):
    pool = spark.createDataFrame([(1, "a"), (1, "b")], "slide_id int, candidate_id string")
    cache = spark.createDataFrame([(1, "a", 0.5, 256), (1, "b", 0.7, 256), (1, "c", None, 256)], "slide_id int, candidate_id string, f double, feature_size int")
    assert tables.reusable_cache(cache, pool, ["f"], 256).count() == 2
    assert tables.reusable_cache(cache, pool, ["f"], 512) is None and tables.reusable_cache(cache, pool, ["g"], 256) is None
    assert tables.reusable_cache(cache.where("candidate_id <> 'b'"), pool, ["f"], 256) is None
    chosen = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "slide_id int, candidate_id string, rank int")
    assert tables.nth_selected(chosen, 1).first()["candidate_id"] == "b"
    with pytest.raises(IndexError):
        tables.nth_selected(chosen, 2)


def test_exports(spark, tmp_path):
    from tilewright.sources import exports
    from tilewright.sources import slides as scan

    boxes = spark.createDataFrame([(1, "a", 0, 0, 24, 1), (1, "b", 512, 64, 24, 2), (2, "a", -8, 3, 24, 1)], "slide_id long, candidate_id string, x_level0 long, y_level0 long, patch_size long, rank int")
    tiles = scan.scan_regions(boxes, scan.PatternSlides)
    done = {(r["slide_id"], r["candidate_id"]): r for r in exports.export_tiles(tiles, str(tmp_path / "tiles")).collect()}
    assert done[1, "b"]["path"].endswith("slide_1/patch_0001_x512_y64.png") and len(list((tmp_path / "tiles").rglob("*"))) == 5
    back = {r["path"]: r for r in exports.scan_pictures(spark.createDataFrame([(r["path"],) for r in done.values()] + [(str(tmp_path / "none.png"),)], "path string")).collect()}
    for r in tiles.collect():
        assert back[done[r["slide_id"], r["candidate_id"]]["path"]]["rgb"] == r["rgb"]
    assert back[str(tmp_path / "none.png")]["error"].startswith("FileNotFoundError")
    copies = exports.copy_files(spark.createDataFrame([(r["path"],) for r in list(done.values())[:1]], "path string"), f"file://{tmp_path}/copies").collect()
    assert copies[0]["n_bytes"] == list(done.values())[0]["n_bytes"]
    arrays = exports.export_arrays(spark.createDataFrame([("p", [1.0, 2.5]), ("q", [3.0, 4.0])], "k string, v array<double>"), str(tmp_path / "npy"), "k", "v")
    rows = exports.scan_arrays(arrays, (2,)).collect()
    assert sorted(r["values"] for r in rows) == [[1.0, 2.5], [3.0, 4.0]]
    with pytest.raises(Exception, match="has shape"):
        exports.scan_arrays(arrays, (3,)).collect()


def test_png_filters():
    """Every row filter, made by hand, gives the picture back."""
    import struct
    import zlib

    from tilewright.sources import exports

    r = np.random.default_rng(1)
    p = r.integers(0, 256, (10, 7, 3)).astype(int)
    lines = b""
    for y in range(10):
        kind = y % 5
        line = []
        for x in range(7):
            for c in range(3):
                a, b, d = (p[y, x - 1, c] if x else 0), (p[y - 1, x, c] if y else 0), (p[y - 1, x - 1, c] if x and y else 0)
                g = a + b - d
                paeth = min((abs(g - a), 0, a), (abs(g - b), 1, b), (abs(g - d), 2, d))[2]
                line.append((p[y, x, c] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (exports.png_pixels(data) == p).all() and (exports.png_pixels(exports.png(p.astype(np.uint8))) == p).all()
    with pytest.raises(ValueError):
        exports.png_pixels(b"GIF89a")


def test_paths_with_a_scheme(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    sinks.json_document({"b": 1}, f"{folder}/d.json")
    sinks.json_document({"b": 2}, f"{folder}/d.json")
    assert json.loads((tmp_path / "out" / "d.json").read_text()) == {"b": 2} and sinks.exists(f"{folder}/d.json") and not sinks.exists(f"{folder}/e.json")
    with pytest.raises(FileExistsError):
        sinks.guarded(folder)
    assert sinks.guarded(folder, overwrite=True) == folder
    for bad in ("file:///", folder):
        with pytest.raises(ValueError):
            sinks.guarded(bad, overwrite=True, forbidden=(folder,))


def test_selection_metrics(spark):
    from tilewright.plans import comparison

    rows = [(1, f"c{i}", i * 1024, 0, 1024, i, 0.1 * i, "x" * (i % 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "slide_id long, candidate_id string, x_level0 long, y_level0 long, patch_size long, rank int, tissue_ratio double, cluster_id string")
    df = df.withColumn("unit", F.expr("array(1.0D, cast(rank as double))")).withColumn("embedding", F.col("unit"))
    slides = spark.createDataFrame([(1, 8192, 4096)], "slide_id long, slide_width long, slide_height long")
    extra = spark.createDataFrame([(1, "baseline", "runtime_seconds", "2.5"), (1, "smart", "runtime_seconds", "2.0"), (1, "smart", "nuclear_proxy", "hed")], "slide_id long, method string, metric string, value string")
    got = comparison.metric_table(comparison.selection_metrics(df.where("rank < 4"), df.where("rank > 1"), slides, extra)).orderBy("position").collect()
    at = {r["metric"]: r for r in got}
    assert len(got) == 45 and [r["position"] for r in got] == list(range(45))
    assert at["num_overlap_selected"]["smart_value"] == "2" and at["jaccard_selected"]["interpretation"] == "descriptive"
    assert at["runtime_seconds"]["interpretation"] == "smart better" and at["runtime_seconds"]["relative_delta"] == pytest.approx(-0.2)
    assert at["nuclear_proxy"]["smart_value"] == "hed" and at["nuclear_proxy"]["delta_smart_minus_baseline"] is None
    assert at["mean_tissue_ratio_recomputed"]["interpretation"] == "smart better" and at["quota_fill_rate"]["interpretation"] == "missing"
    assert float(at["num_embedding_clusters_covered"]["smart_value"]) == 2 and at["mean_pairwise_embedding_distance"]["smart_value"] is not None


def test_documents(spark):
    from tilewright.functions import documents

    assert documents.ordered_unique(["b", "a"], ["a", "c", "b"]) == ["b", "a", "c"]
    assert documents.utc_now().endswith("+00:00")
    assert [x[0] for x in values(spark, [("CUDA out of memory",), ("Cannot allocate 5 GB",), ("no file",), (None,)], "m string", c=documents.is_memory_fault(F.col("m")))] == [True, True, False, False]
    assert documents.json_safe({1: np.arange(2), "a": [np.float32(0.5), {"b": (1, None)}], "p": Exception("x")}) == {"1": [0, 1], "a": [0.5, {"b": [1, None]}], "p": "x"}
    numbers = [0.1234565, 2.5, -0.0000005, 1e10, None, float("nan")]
    got = [x[0] for x in values(spark, [(n,) for n in numbers], "v double", s=documents.shown_column(F.col("v"), 6, "n/a"))]
    assert got == [f"{n:.6f}" if n is not None and n == n else "n/a" for n in numbers]
    table = spark.createDataFrame([("m", "1.5", "x", ""), ("n", None, "2", "-1e3"), ("m", "2", "3", "1")], "metric string, baseline_value string, smart_value string, delta_smart_minus_baseline string").coalesce(1)
    assert {r["metric"]: tuple(r)[1:] for r in documents.metric_values(table).collect()} == {"m": (2.0, 3.0, 1.0), "n": (None, 2.0, -1000.0)}
    a, b = (spark.createDataFrame([(i, i * k) for i in range(3)], f"position int, v{k} int") for k in (1, 2))
    assert sorted(map(tuple, documents.in_order(a, b).collect())) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]
    with pytest.raises(Exception, match="no partner at position 2"):
        documents.in_order(a, b.where("position < 2")).collect()


def test_model_output():
    from tilewright.functions import documents

    p = np.random.default_rng(1).random((5, 8, 9))
    labels, chance, at, chance_at = documents.model_output({"run": [{"probs": p[None]}]})
    assert (labels == p.argmax(0)).all() and chance.shape == (8, 9, 5) and (at, chance_at) == ("argmax of run[0].probs", "run[0].probs")
    labels, chance, at, _ = documents.model_output({"label": np.zeros((8, 9), int), "prediction": np.ones((1, 8, 9), int), "probabilities": np.moveaxis(p, 0, -1)})
    assert labels.sum() == 72 and at == "prediction" and chance.shape == (8, 9, 5)
    for bad in ({"labels": np.zeros((8, 9))}, {"labels": np.zeros((3, 3)), "probs": p}):
        with pytest.raises(ValueError):
            documents.model_output(bad)


def test_legend():
    p = overlay.legend({3: 0.5, 1: 1.0}, width=100, row=10)
    assert p.shape == (20, 100, 3) and (p[5, 5] == overlay.colour(1)).all() and (p[15, 5] == overlay.colour(3)).all()
    bar = lambda y: int((p[y, 12:] != 255).any(-1).sum())
    assert bar(5) == 80 and bar(15) == 40
    both = overlay.below(np.zeros((4, 30, 3), np.uint8), p)
    assert both.shape == (32, 100, 3) and (both[0, 40] == 255).all() and (both[:4, :30] == 0).all()
    assert overlay.legend({}).shape[0] == 12
