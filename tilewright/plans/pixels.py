"""Queries on rasters, label masks and probability cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import raster, score
from tilewright.operators import evaluate, stitch
from tilewright.plans.sql import clip, oracle, r6
from tilewright.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def picked(spark, d: str, *features: str) -> DataFrame:
    """Features of every tile from the one raster pass."""
    return raster.with_features(fx.tiles(spark, d)).select("tile_id", *[F.round(f, 6).alias(f) for f in features])


#: Rows on tissue, or all rows of a tile without tissue.
INSIDE = "ins as (select * from (select *, bool_or(tissue) over (partition by tile_id) as has_tissue from fx_px) where tissue or not has_tissue)"


def _entropy(grey: str, bins: int, source: str, group: str = "tile_id") -> str:
    return f"""(select {group}, -sum(n/t*log2(n/t))/log2({bins}) as h from (select {group}, n::double as n, sum(n) over (partition by {group})::double as t from
(select {group}, least(cast(floor({grey}*{bins}) as integer), {bins - 1}) as bin, count(*) as n from {source} group by all)) group by all)"""


@query(oracle(f"select tile_id, {r6('avg(tissue::int::double)')} as tissue_ratio from fx_px group by 1", "fx_px"))
def pixel_tissue_mask(spark, d):
    return picked(spark, d, "tissue_ratio")


@query(oracle(f"also {INSIDE} select tile_id, {r6('h')} as visual_entropy from {_entropy('grey', 32, 'ins')}", "fx_px"))
def pixel_entropy(spark, d):
    return picked(spark, d, "visual_entropy")


@query(oracle(f"select tile_id, {r6('var_pop(dx) + var_pop(dy)')} as blur_score from (select tile_id, lead(grey) over (partition by tile_id, y order by x) - grey as dx, lead(grey) over (partition by tile_id, x order by y) - grey as dy from fx_px) group by 1", "fx_px"))
def pixel_blur(spark, d):
    return picked(spark, d, "blur_score")


ARTIFACT = clip("0.35*white + 0.20*black + 0.15*strong + 0.15*" + clip("(0.20 - ratio)/0.20") + " + 0.15*" + clip("(0.15 - h)/0.15"))


@query(oracle(f"""also {INSIDE} select tile_id, {r6(ARTIFACT)} as artifact_penalty from (select tile_id, avg((bright > 0.92 and sat < 0.08)::int::double) as white, avg((bright < 0.05)::int::double) as black, avg((sat > 0.80)::int::double) as strong, avg(tissue::int::double) as ratio from fx_px group by 1) join {_entropy('grey', 32, 'ins')} using (tile_id)""", "fx_px"))
def pixel_artifact(spark, d):
    return picked(spark, d, "artifact_penalty")


@query(oracle(f"also {INSIDE} select tile_id, {r6(clip('avg(greatest(0, (r+b)/2.0/255 - g/255.0)*sat*(1-bright))*4'))} as nuclear_signal_rgb from ins group by 1", "fx_px"))
def pixel_purple(spark, d):
    return picked(spark, d, "nuclear_signal_rgb")


@query(oracle(f"also {INSIDE} select tile_id, {r6(clip('(0.6*quantile_cont(hem, 0.9) + 0.4*avg(hem))/1.5'))} as nuclear_signal_hed from ins group by 1", "fx_px"))
def pixel_hed(spark, d):
    return picked(spark, d, "nuclear_signal_hed")


SLOPE = """slope as (select tile_id, sqrt(dx*dx + dy*dy) as m from (select tile_id,
 case when x = 0 then rt - grey when x = 7 then grey - lt else (rt - lt)/2 end as dx, case when y = 0 then dn - grey when y = 7 then grey - up else (dn - up)/2 end as dy from
 (select *, lead(grey) over r as rt, lag(grey) over r as lt, lead(grey) over c as dn, lag(grey) over c as up from fx_px window r as (partition by tile_id, y order by x), c as (partition by tile_id, x order by y))))"""


@query(oracle(f"also {SLOPE} select tile_id, {r6(clip('8*avg(m)'))} as gradient_energy_score, {r6(clip('80*avg(m*m)'))} as tenengrad_sharpness_score, {r6(clip('4*avg((m > 0.35)::int::double)'))} as fold_or_edge_artifact_penalty from slope group by 1", "fx_px"))
def pixel_gradient(spark, d):
    return picked(spark, d, "gradient_energy_score", "tenengrad_sharpness_score", "fold_or_edge_artifact_penalty")


@query(oracle(f"""select tile_id, {r6(clip('8*avg(abs(l))'))} as laplacian_texture_score, {r6(clip('80*var_pop(l)'))} as laplacian_sharpness_score from
(select tile_id, coalesce(lag(grey) over r, grey) + coalesce(lead(grey) over r, grey) + coalesce(lag(grey) over c, grey) + coalesce(lead(grey) over c, grey) - 4*grey as l from fx_px window r as (partition by tile_id, y order by x), c as (partition by tile_id, x order by y)) group by 1""", "fx_px"))
def pixel_laplacian(spark, d):
    return picked(spark, d, "laplacian_texture_score", "laplacian_sharpness_score")


@query(oracle(f"""also q as (select *, least(15, cast(floor(grey*16) as integer)) as lv, bool_or(tissue) over (partition by tile_id) as has_tissue from fx_px),
pr as (select tile_id, dir, abs(lv - nv) as dist from (select tile_id, 'r' as dir, lv, has_tissue, tissue, lead(lv) over r as nv, lead(tissue) over r as nt from q window r as (partition by tile_id, y order by x)
 union all select tile_id, 'd', lv, has_tissue, tissue, lead(lv) over c, lead(tissue) over c from q window c as (partition by tile_id, x order by y)) where nv is not null and ((tissue and nt) or not has_tissue))
select tile_id, round({clip('4*avg(c)')}, 9) as glcm_contrast_proxy, round({clip('avg(h)')}, 9) as glcm_homogeneity_proxy from (select tile_id, dir, avg((dist/15.0)*(dist/15.0)) as c, avg(1.0/(1+dist)) as h from pr group by 1, 2) group by 1""", "fx_px"))
def pixel_glcm(spark, d):
    # nine decimals: of the means' denominators none has a tie there
    f = raster.with_features(fx.tiles(spark, d))
    return f.select("tile_id", *[F.round(c, 9).alias(c) for c in ("glcm_contrast_proxy", "glcm_homogeneity_proxy")])


@query(oracle(f"select tile_id, {r6('v')} as border_background_ratio, {r6(clip('greatest(0, v - 0.30)/0.70'))} as border_tissue_penalty from (select tile_id, avg((not tissue)::int::double) as v from fx_px where y in (0, 7) or x in (0, 7) group by 1)", "fx_px"))
def pixel_border(spark, d):
    return picked(spark, d, "border_background_ratio", "border_tissue_penalty")


@query(oracle(f"""also {INSIDE} select tile_id, {r6(clip('(quantile_cont(grey, 0.95) - quantile_cont(grey, 0.05))/0.55'))} as stain_contrast_score, {r6(clip('(quantile_cont(hem, 0.95) - quantile_cont(hem, 0.05))/1.2'))} as hematoxylin_dynamic_range, {r6(clip('(quantile_cont(eos, 0.95) - quantile_cont(eos, 0.05))/1.2'))} as eosin_dynamic_range from ins group by 1""", "fx_px"))
def pixel_dynamic_range(spark, d):
    return picked(spark, d, "stain_contrast_score", "hematoxylin_dynamic_range", "eosin_dynamic_range")


@query(oracle(f"select tile_id, {r6(clip('3*avg((sat > 0.82 or (sat < 0.03 and bright > 0.85))::int::double)'))} as stain_saturation_penalty, {r6(clip('3*avg((bright > 0.78 and sat < 0.12 and not tissue)::int::double)'))} as fat_background_penalty, {r6(clip('4*avg((bright < 0.03 or bright > 0.97)::int::double)'))} as extreme_intensity_penalty from fx_px group by 1", "fx_px"))
def pixel_penalties(spark, d):
    return picked(spark, d, "stain_saturation_penalty", "fat_background_penalty", "extreme_intensity_penalty")


@query(oracle("""also node as (select tile_id, y, x, y*8+x as id from fx_px where tissue), lab as (select 0 as k, tile_id, y, x, id from node union all
select k + 1, tile_id, y, x, least(id, coalesce(l, id), coalesce(r, id), coalesce(u, id), coalesce(d, id)) from (select a.k, a.tile_id, a.y, a.x, a.id,
 max(case when b.y = a.y and b.x = a.x-1 then b.id end) as l, max(case when b.y = a.y and b.x = a.x+1 then b.id end) as r, max(case when b.x = a.x and b.y = a.y-1 then b.id end) as u, max(case when b.x = a.x and b.y = a.y+1 then b.id end) as d
 from lab a join lab b on a.tile_id = b.tile_id and abs(a.y-b.y) + abs(a.x-b.x) <= 1 where a.k < 40 group by 1, 2, 3, 4, 5))
select t.tile_id, coalesce(n, 0) as n_components, coalesce(largest, 0) as largest from (select distinct tile_id from fx_px) t left join (select tile_id, count(*) as n, max(c) as largest from (select tile_id, id, count(*) as c from lab where k = 40 group by 1, 2) group by 1) using (tile_id)""", "fx_px", recursive=True))
def components(spark, d):
    return raster.with_components(fx.tiles(spark, d))


def _composites() -> str:
    """The eight scores over the features, as nested selects."""
    text = "(select *, cast(0 as double) as tumor_bed_relevance_proxy from feats)"
    for name, weights in score.COMPOSITE_WEIGHTS.items():
        total = " + ".join(f"cast({w} as double)*{'(1 - ' + n[1:] + ')' if n[0] == '~' else n}" for n, w in weights.items())
        text = f"(select *, {clip(total)} as {name} from {text})"
    return "select tile_id, " + ", ".join(f"{r6(n)} as {n}" for n in score.COMPOSITE_WEIGHTS) + f" from {text}"


@query()
def medical_scores(spark, d):
    """Eight composite scores as column expressions over the raster pass."""
    s = score.composite_scores(raster.with_features(fx.tiles(spark, d)))
    return s.select("tile_id", *[F.round(c, 6).alias(c) for c in score.COMPOSITE_WEIGHTS])


#: Features of fx_embed's components as stand-ins, so that SQL can check the expressions of the composite scores.
STAND_INS = list(dict.fromkeys(n.lstrip("~") for w in score.COMPOSITE_WEIGHTS.values() for n in w if not n.lstrip("~").startswith(("medical_", "tumor_"))))
FEATS = ", ".join(f"abs(embedding[{i + 1}])*3 as {n}" for i, n in enumerate(STAND_INS))


@query(oracle(f"also feats as (select vec_id as tile_id, {FEATS} from fx_embed) {_composites()}", "fx_embed"))
def composite_expressions(spark, d):
    e = fx.embeddings(spark, d).select(F.col("vec_id").alias("tile_id"), *[(F.abs(F.get("embedding", F.lit(i))) * 3).alias(n) for i, n in enumerate(STAND_INS)])
    return score.composite_scores(e).select("tile_id", *[F.round(c, 6).alias(c) for c in score.COMPOSITE_WEIGHTS])


# Label masks.


@query(oracle(f"select mask_id, y_true as class_id, count(*) as pixels, {r6('count(*)/64.0')} as ratio from fx_labels group by 1, 2", "fx_labels"))
def class_distribution(spark, d):
    return evaluate.class_distribution(fx.label_pixels(spark, d), "mask_id", "y_true").withColumn("ratio", F.round("ratio", 6))


@query(oracle("select mask_id, arg_max(y_pred, row(n, y_pred)) as dominant from (select mask_id, y_pred, count(*) as n from fx_labels group by 1, 2) group by 1", "fx_labels"))
def dominant_class(spark, d):
    n = fx.label_pixels(spark, d).groupBy("mask_id", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("mask_id").agg(F.max_by("y_pred", F.struct("n", "y_pred")).alias("dominant"))


@query(oracle(f"select mask_id, {r6('avg((y_true = y_pred)::int::double)')} as accuracy, {r6('avg(case when y_true <> 0 then (y_true = y_pred)::int::double end)')} as accuracy_ignore_0 from fx_labels group by 1", "fx_labels"))
def pixel_accuracy(spark, d):
    p = fx.label_pixels(spark, d)
    t, q = F.col("y_true"), F.col("y_pred")
    return p.groupBy("mask_id").agg(F.round(evaluate.accuracy(t, q), 6).alias("accuracy"), F.round(evaluate.accuracy(t, q, 0), 6).alias("accuracy_ignore_0"))


IOU = "(select mask_id, c as class_id, count(*) filter (y_true = c and y_pred = c)::double / count(*) filter (y_true = c or y_pred = c) as iou from fx_labels, (select unnest(range(5)) as c) group by 1, 2 having count(*) filter (y_true = c or y_pred = c) > 0)"


@query(oracle(f"select mask_id, {r6('avg(iou)')} as mean_iou from {IOU} group by 1", "fx_labels"))
def mean_iou(spark, d):
    return evaluate.mean_iou(fx.label_pixels(spark, d), "mask_id", "y_true", "y_pred", 5).withColumn("mean_iou", F.round("mean_iou", 6))


@query(oracle(f"select mask_id, cast(class_id as integer) as class_id, {r6('iou')} as iou from {IOU}", "fx_labels"))
def iou_by_class(spark, d):
    return evaluate.iou_by_class(fx.label_pixels(spark, d), "mask_id", "y_true", "y_pred").withColumn("iou", F.round("iou", 6))


@query(oracle(f"""select mask_id, {r6('agreement')} as agreement, {r6('macro_iou')} as macro_iou, {r6('far')} as largest_ratio_difference from (select mask_id, avg((y_true = y_pred)::int::double) as agreement from fx_labels group by 1)
join (select mask_id, avg(iou) as macro_iou from {IOU} group by 1) using (mask_id) join (select mask_id, max(abs(a - b)) as far from (select mask_id, c, count(*) filter (y_true = c)/64.0 as a, count(*) filter (y_pred = c)/64.0 as b from fx_labels, (select unnest(range(5)) as c) group by 1, 2) group by 1) using (mask_id)""", "fx_labels"))
def label_agreement(spark, d):
    a = evaluate.agreement(fx.label_pixels(spark, d), "mask_id", "y_true", "y_pred")
    return a.withColumns({c: F.round(c, 6) for c in ("agreement", "macro_iou", "largest_ratio_difference")})


@query(oracle("select mask_id, cast(ty as bigint) as y, cast(tx as bigint) as x, y_true from (select unnest(range(5)) as ty), (select unnest(range(13)) as tx), fx_labels where y = cast(floor((ty + 0.5)*8/5) as bigint) and x = cast(floor((tx + 0.5)*8/13) as bigint)", "fx_labels"))
def nearest_resize(spark, d):
    return stitch.nearest_pixels(fx.label_pixels(spark, d), "mask_id", 8, 8, 5, 13, "y_true")


def _quads(p: DataFrame, label: str) -> DataFrame:
    """Four masks as the windows of one tile of 16 x 16."""
    k = F.col("mask_id") % 4
    return p.select(F.floor(F.col("mask_id") / 4).alias("tile_id"), "y", "x", (k % 2 * 8).alias("dx"), (F.floor(k / 2) * 8).alias("dy"), F.col(label).alias("label"))


STITCHED = "(select mask_id // 4 as tile_id, y + (mask_id % 4) // 2 * 8 as y, x + mask_id % 2 * 8 as x, y_true as label from fx_labels)"


@query(oracle(f"select * from {STITCHED}", "fx_labels"))
def stitch_quadrants(spark, d):
    return stitch.stitched(_quads(fx.label_pixels(spark, d), "y_true"), "tile_id")


@query(oracle(f"""select l.tile_id, cast(8 as integer) as seam, {r6('avg((l.label <> r.label)::int::double)')} as disagreement from {STITCHED} l join {STITCHED} r on l.tile_id = r.tile_id and l.y = r.y and r.x = l.x + 3 where l.x >= 5 and l.x < 8 group by 1""", "fx_labels"))
def seam_metrics(spark, d):
    return stitch.seams(stitch.stitched(_quads(fx.label_pixels(spark, d), "y_true"), "tile_id"), "tile_id", [8, 15], 3, 16).withColumn("disagreement", F.round("disagreement", 6))


@query(oracle(f"""select a.mask_id, dy, dx, count(*) as compared, {r6('avg((a.y_true = b.y_pred)::int::double)')} as agreement from (select unnest(range(-2, 3))::integer as dy), (select unnest(range(-2, 3))::integer as dx), fx_labels a join fx_labels b on a.mask_id = b.mask_id where a.y = b.y + dy and a.x = b.x + dx group by 1, 2, 3""", "fx_labels"))
def offset_search(spark, d):
    p = fx.label_pixels(spark, d)
    s = stitch.offset_search(p.withColumnRenamed("y_true", "label"), p.withColumnRenamed("y_pred", "label"), "mask_id", 2)
    return s.withColumn("agreement", F.round("agreement", 6))


# Probability cubes.


@query(oracle(f"""select cube_id, {r6('avg(m)')} as mean_max, {r6('quantile_cont(m, 0.5)')} as median_max, {r6('min(m)')} as min_max, {r6('max(m)')} as max_max, {r6('avg(h)')} as mean_entropy, {r6('quantile_cont(h, 0.5)')} as median_entropy from (select cube_id, y, x, max(p) as m, sum(-p*log2(p))/log2(5) as h from fx_probs group by 1, 2, 3) group by 1""", "fx_probs"))
def prob_summary(spark, d):
    s = stitch.probability_summary(fx.probabilities(spark, d), "cube_id", 5)
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c != "cube_id"})


@query(oracle(f"select cube_id, y, x, arg_max(class, row(p, -class)) as label, {r6('max(p)')} as p from fx_probs group by 1, 2, 3", "fx_probs"))
def prob_argmax(spark, d):
    return stitch.argmax(fx.probabilities(spark, d), ["cube_id", "y", "x"]).withColumn("p", F.round("p", 6))


def _places(p: DataFrame) -> DataFrame:
    """Four cubes as overlapping windows of a tile of 12 x 12, at a stride of 4."""
    k = F.col("cube_id") % 4
    return p.select(F.floor(F.col("cube_id") / 4).alias("tile_id"), "y", "x", "class", "p", (F.col("y") + F.floor(k / 2) * 4).alias("ty"), (F.col("x") + k % 2 * 4).alias("tx"))


def _weighted(p: DataFrame, feathered: bool) -> DataFrame:
    n = F.lit(8)
    top = stitch.hann_top(n) * stitch.hann_top(n)
    return p.withColumn("weight", stitch.feather(F.col("y"), F.col("x"), n, n, top) if feathered else F.lit(1.0))


HANN = "greatest(0.05, (0.5 - 0.5*cos(2*pi()*y/7))*(0.5 - 0.5*cos(2*pi()*x/7))/((0.5 - 0.5*cos(2*pi()*3/7))*(0.5 - 0.5*cos(2*pi()*3/7))))"


def _blended(weight: str) -> str:
    return f"select tile_id, ty, tx, class, {r6('sum(p*w)/sum(w)')} as p from (select cube_id // 4 as tile_id, y + (cube_id % 4) // 2 * 4 as ty, x + cube_id % 2 * 4 as tx, class, p, {weight} as w from fx_probs) group by 1, 2, 3, 4"


@query(oracle(_blended("1.0"), "fx_probs"))
def blend_uniform(spark, d):
    return stitch.blend(_weighted(_places(fx.probabilities(spark, d)), False), ["tile_id", "ty", "tx"], "weight").withColumn("p", F.round("p", 6))


@query(oracle(_blended(HANN), "fx_probs"))
def blend_feathered(spark, d):
    return stitch.blend(_weighted(_places(fx.probabilities(spark, d)), True), ["tile_id", "ty", "tx"], "weight").withColumn("p", F.round("p", 6))


@query(oracle(f"""select tile_id, cast(case when count(*) < 144 then 0 else min(n) end as bigint) as min_count, max(n) as max_count, {r6('sum(n)/144.0')} as mean_count, cast(144 - count(*) as bigint) as uncovered, {r6('count(*) filter (n > 1)/144.0*100')} as multi_covered_percent, {r6('min(w)')} as min_weight, {r6('max(w)')} as max_weight from
(select cube_id // 4 as tile_id, y + (cube_id % 4) // 2 * 4 as ty, x + cube_id % 2 * 4 as tx, count(*) as n, sum({HANN}) as w from fx_probs where class = 0 group by 1, 2, 3) group by 1""", "fx_probs"))
def coverage_summary(spark, d):
    p = _weighted(_places(fx.probabilities(spark, d).where("class = 0")), True)
    n = p.groupBy("tile_id", "ty", "tx").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    s = stitch.coverage(n, 12, "tile_id")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_count", "multi_covered_percent", "min_weight", "max_weight")})
