"""Queries on grids, scores and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import score
from tilewright.operators import gates, grid, select, stats
from tilewright.plans import selectors
from tilewright.plans.sql import FEATURES, oracle, r6
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


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def dims(c: DataFrame) -> DataFrame:
    return c.groupBy("slide_id").agg(F.lit(40 * fx.TILE).cast("long").alias("slide_width"), (F.max("y_level0") + fx.TILE).alias("slide_height"))


def scored(spark, d: str) -> DataFrame:
    return score.smart_score(fx.candidates(spark, d, dealt=True))


def regioned(spark, d: str) -> DataFrame:
    s = scored(spark, d)
    return select.with_regions(s.join(dims(fx.candidates(spark, d)), "slide_id"))


def runs(spark, d: str) -> DataFrame:
    """Two selections of 16 a slide: baseline by a linear hash of the tile, smart by score."""
    s = scored(spark, d)
    cols = ["slide_id", "candidate_id", "x_level0", "y_level0", "patch_size", "score_raw", "rank"]
    a = select.top_k(s, 16, [(F.col("part") * 7919 + F.col("slide_id") * 104729) % 10007, F.col("candidate_id")])
    b = select.top_k(s, 16, [F.desc("score_raw"), F.col("candidate_id")])
    return a.select(F.lit("baseline").alias("method"), *cols).unionByName(b.select(F.lit("smart").alias("method"), *cols))


# Grids.


@query(oracle("""select slide_id, (y//1024)*((slide_width-1024)//1024+1) + x//1024 as grid_index, x as x_level0, y as y_level0 from
(select *, unnest(range(0, slide_width-1023, 1024)) as x from (select *, unnest(range(0, slide_height-1023, 1024)) as y from fx_slides where slide_width >= 1024 and slide_height >= 1024))""", "fx_slides"))
def grid_generate(spark, d):
    return grid.grid(fx.slides(spark, d), fx.TILE).select("slide_id", "grid_index", "x_level0", "y_level0")


EDGE = """select slide_id, x as x_level0, y as y_level0, least(1000, slide_width-x) as original_width, least(1000, slide_height-y) as original_height, least(1000, slide_width-x) < 1000 or least(1000, slide_height-y) < 1000 as padded from
(select *, unnest({0}) as x from (select *, unnest({1}) as y from fx_slides))"""


def _edges(size: str, edge: str) -> str:
    whole = f"range(0, greatest({size}-1000, 0)+1, 800)"
    if edge == "overlap":
        return f"case when {size} < 1000 then [cast(0 as bigint)] else list_distinct(list_concat({whole}, [{size}-1000])) end"
    return f"range(0, {size}, 800)"


@query(oracle(EDGE.format(_edges("slide_width", "overlap"), _edges("slide_height", "overlap")), "fx_slides"))
def grid_edge_overlap(spark, d):
    return grid.edge_grid(fx.slides(spark, d), 1000, 800, "overlap").select("slide_id", "x_level0", "y_level0", "original_width", "original_height", "padded")


@query(oracle(EDGE.format(_edges("slide_width", "pad"), _edges("slide_height", "pad")), "fx_slides"))
def grid_edge_pad(spark, d):
    return grid.edge_grid(fx.slides(spark, d), 1000, 800, "pad").select("slide_id", "x_level0", "y_level0", "original_width", "original_height", "padded")


@query(oracle("""select slide_id, coalesce(min(case when s > reach then reach end), max(e)) as covered_to, coalesce(min(case when s > reach then reach end), max(e)) >= max(n) as fully_covered from
(select *, coalesce(max(e) over (partition by slide_id order by s, e rows between unbounded preceding and 1 preceding), 0) as reach from
(select distinct slide_id, x_level0 as s, x_level0 + patch_size as e, slide_width as n from fx_cand join fx_dims using (slide_id))) group by slide_id""", "fx_cand", "fx_dims"))
def grid_coverage(spark, d):
    c = fx.candidates(spark, d)
    return grid.covered(c.join(dims(c), "slide_id"), "slide_id", "x_level0", "patch_size", "slide_width")


BOX = """select s.*, x0, y0, greatest(x0+1, least(cast(ceil((x_level0+1024)*tw/slide_width) as bigint), tw)) as x1, greatest(y0+1, least(cast(ceil((y_level0+1024)*th/slide_height) as bigint), th)) as y1 from
(select *, greatest(0, least(cast(floor(x_level0*tw/slide_width) as bigint), tw-1)) as x0, greatest(0, least(cast(floor(y_level0*th/slide_height) as bigint), th-1)) as y0 from
(select *, (y//1024)*((slide_width-1024)//1024+1) + x//1024 as grid_index, x as x_level0, y as y_level0, cast(ceil(slide_width/256) as bigint) as tw, cast(ceil(slide_height/256) as bigint) as th from
(select *, unnest(range(0, slide_width-1023, 1024)) as x from (select *, unnest(range(0, slide_height-1023, 1024)) as y from fx_slides where slide_width >= 1024 and slide_height >= 1024)))) s"""


def _boxes(spark, d):
    g = grid.grid(fx.slides(spark, d), fx.TILE).withColumn("patch_size", F.lit(fx.TILE).cast("long"))
    thumb = lambda c: F.ceil(F.col(c) / fx.THUMB).cast("long")
    return grid.thumbnail_box(g, "slide_width", "slide_height", thumb("slide_width"), thumb("slide_height"))


@query(oracle(f"select slide_id, grid_index, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1 from ({BOX})", "fx_slides"))
def thumb_bbox(spark, d):
    return _boxes(spark, d).select("slide_id", "grid_index", "bx0", "by0", "bx1", "by1")


RATIO = f"select b.slide_id, b.grid_index, avg(cast(m.tissue as double)) as ratio from ({BOX}) b join fx_mask m on m.slide_id = b.slide_id and m.tx >= b.x0 and m.tx < b.x1 and m.ty >= b.y0 and m.ty < b.y1 group by 1, 2"


def _ratios(spark, d):
    return grid.tissue_ratio(_boxes(spark, d), fx.mask(spark, d), ["slide_id", "grid_index"])


@query(oracle(f"select slide_id, grid_index, {r6('ratio')} as thumbnail_tissue_ratio from ({RATIO})", "fx_slides", "fx_mask"))
def thumb_tissue_ratio(spark, d):
    return rounded(_ratios(spark, d), "thumbnail_tissue_ratio")


@query(oracle(f"select slide_id, concat('candidate_', lpad(cast(grid_index as varchar), 6, '0')) as candidate_id, {r6('ratio')} as thumbnail_tissue_ratio from ({RATIO}) where ratio >= 0.55", "fx_slides", "fx_mask"))
def candidates_filtered(spark, d):
    kept = grid.named(_ratios(spark, d).where("thumbnail_tissue_ratio >= 0.55"))
    return rounded(kept.select("slide_id", "candidate_id", "thumbnail_tissue_ratio"), "thumbnail_tissue_ratio")


@query(oracle("""select tile_id, arg_max(level, row(between_, -level)) as threshold from (select *, round(coalesce(case when w0 = 0 or w0 = w then null else w0*(w-w0)*(s0/w0-(s-s0)/(w-w0))*(s0/w0-(s-s0)/(w-w0)) end, -1), 6) as between_ from
(select tile_id, level, sum(n) over (partition by tile_id order by level)::double as w0, sum(n*level) over (partition by tile_id order by level)::double as s0, sum(n) over (partition by tile_id)::double as w, sum(n*level) over (partition by tile_id)::double as s from
(select tile_id, cast(floor((299*r + 587*g + 114*b)/1000) as bigint) as level, count(*) as n from fx_pixels group by 1, 2))) group by tile_id""", "fx_pixels"))
def otsu_threshold(spark, d):
    z = fx.tile_planes(spark, d).select("tile_id", F.explode(F.arrays_zip("r", "g", "b")).alias("z"))
    level = F.floor((F.col("z.r") * 299 + F.col("z.g") * 587 + F.col("z.b") * 114) / 1000)
    return grid.otsu(z.groupBy("tile_id", level.alias("level")).agg(F.count(F.lit(1)).alias("n")), "tile_id")


@query(oracle("""select slide_id, candidate_id, accepted, case when accepted then before else read_ - before end as number from
(select *, coalesce(sum(accepted::int) over (partition by slide_id order by candidate_id rows between unbounded preceding and 1 preceding), 0)::bigint as before, count(*) over (partition by slide_id order by candidate_id rows between unbounded preceding and 1 preceding) as read_ from
(select *, tissue_ratio >= 0.7 as accepted from fx_cand)) where before < 16""", "fx_cand"))
def accept_until_k(spark, d):
    """Tiles that share an id, beyond a million parts, are read by part; the SQL leaves their order open."""
    found = grid.accept_until(fx.candidates(spark, d), "slide_id", [F.col("candidate_id"), F.col("part")], F.col("tissue_ratio") >= 0.7, 16)
    return found.select("slide_id", "candidate_id", "accepted", "number")


# Scores.


@query(oracle("select slide_id, candidate_id, " + ", ".join(f"{r6(c + '_norm')} as {c}_norm" for c in FEATURES) + " from fx_norm", "fx_norm"))
def normalize_features(spark, d):
    n = score.normalise(fx.candidates(spark, d), FEATURES)
    return rounded(n.select("slide_id", "candidate_id", *[f"{c}_norm" for c in FEATURES]), *[f"{c}_norm" for c in FEATURES])


@query(oracle(f"select slide_id, candidate_id, {r6('score_raw')} as score_raw from fx_smart", "fx_smart"))
def smart_score(spark, d):
    return rounded(scored(spark, d).select("slide_id", "candidate_id", "score_raw"), "score_raw")


PROXIES = {"cell": "cellularity_proxy_score", "qual": "technical_quality_score", "het": "heterogeneity_score", "resid": "residual_candidate_proxy", "low": "low_cellularity_treated_bed_proxy", "bed": "tumor_bed_relevance_proxy", "score_raw": "score_raw"}


@query(oracle("select slide_id, candidate_id, " + ", ".join(f"{r6(a)} as {b}" for a, b in PROXIES.items()) + " from fx_quality", "fx_quality"))
def v3_scores(spark, d):
    q = score.quality_scores(fx.candidates(spark, d))
    return rounded(q.select("slide_id", "candidate_id", *PROXIES.values()), *PROXIES.values())


@query(oracle("select slide_id, usefulness_reason, count(*) as n from fx_quality group by 1, 2", "fx_quality"))
def v3_reason(spark, d):
    return score.quality_scores(fx.candidates(spark, d)).groupBy("slide_id", "usefulness_reason").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("""select 'mpp_x' as feature, count(*) filter (mpp_x is null) as repaired from fx_slides
union all select 'slide_width', count(*) filter (slide_width is null) from fx_slides""", "fx_slides"))
def sanitize_counts(spark, d):
    s = fx.slides(spark, d).select(F.col("mpp_x"), F.col("slide_width").cast("double"))
    return score.sanitise(s, ["mpp_x", "slide_width"])[1]


# Selections.


@query(oracle("select slide_id, candidate_id, region_row, region_col, region_id from fx_regions", "fx_regions"))
def assign_regions(spark, d):
    return regioned(spark, d).select("slide_id", "candidate_id", "region_row", "region_col", "region_id")


QUOTA = f"""select slide_id, candidate_id, region_id, cast(rank as integer) as rank, {r6('score_raw')} as score_raw from
(select *, row_number() over (partition by slide_id order by turn, region_id) as rank from
(select *, row_number() over (partition by slide_id, region_id order by score_raw desc, candidate_id) as turn from fx_regions)) where rank <= 16"""


@query(oracle(QUOTA, "fx_regions"))
def quota_topk(spark, d):
    return rounded(select.quota_top(regioned(spark, d), 16).select("slide_id", "candidate_id", "region_id", "rank", "score_raw"), "score_raw")


@query(
    oracle(
        f"""also step as (
  select 0 as k, slide_id, candidate_id, x_level0, y_level0, score_raw, cast(0 as double) as pen, first_value(candidate_id) over (partition by slide_id order by score_raw desc, candidate_id) as best from fx_smart
  union all
  select k + 1, slide_id, candidate_id, x_level0, y_level0, score_raw, pen2, first_value(candidate_id) over (partition by slide_id order by score_raw - 0.15*pen2 desc, candidate_id) from
  (select s.*, greatest(s.pen, exp(-sqrt(pow(cast(s.x_level0 - b.x_level0 as double), 2) + pow(cast(s.y_level0 - b.y_level0 as double), 2))/1024)) as pen2 from step s join step b on b.slide_id = s.slide_id and b.candidate_id = b.best where s.candidate_id <> s.best and s.k < 15)
) select slide_id, candidate_id, cast(k + 1 as integer) as rank, {r6('score_raw - 0.15*pen')} as score_final, {r6('pen')} as spatial_penalty from step where candidate_id = best""",
        "fx_smart",
        recursive=True,
    )
)
def greedy_spatial_topk(spark, d):
    p = select.pick(scored(spark, d), select.Terms(k=16, spatial=0.15, scale=1024.0)).where("selected")
    return rounded(p.select("slide_id", "candidate_id", "rank", "score_final", "spatial_penalty"), "score_final", "spatial_penalty")


@query()
def quota_greedy_topk(spark, d):
    """Region round robin with the distance penalty and the feature bonus, over the score's upper three quarters."""
    c = fx.candidates(spark, d)
    p = selectors.run("quota_diverse", c, dims(c), cap=0).where("selected")
    return rounded(p.select("slide_id", "candidate_id", "rank", "score_final"), "score_final")


@query(oracle(f"""select slide_id, candidate_id, {r6('pen')} as spatial_penalty, {r6('score_raw - 0.15*pen')} as score_final from (
select r.slide_id, r.candidate_id, r.score_raw, max(exp(-sqrt(pow(cast(r.x_level0 - s.x_level0 as double), 2) + pow(cast(r.y_level0 - s.y_level0 as double), 2))/1024)) as pen
from fx_smart r join (select * from fx_runs where method = 'smart') s using (slide_id) where not exists (select 1 from fx_runs q where q.method = 'smart' and q.slide_id = r.slide_id and q.candidate_id = r.candidate_id) group by 1, 2, 3)""", "fx_smart", "fx_runs"))
def rescore_unselected(spark, d):
    s = scored(spark, d)
    chosen = select.top_k(s, 16, [F.desc("score_raw"), F.col("candidate_id")])
    return rounded(select.rescored(s, chosen, 0.15, 1024.0).select("slide_id", "candidate_id", "spatial_penalty", "score_final"), "spatial_penalty", "score_final")


@query(oracle(f"""select slide_id, {r6('t')} as threshold, count(*) filter (score_raw >= t) as kept from (select *, min(case when rn = cast(round_even((n-1)*0.25, 0) as bigint) + 1 then score_raw end) over (partition by slide_id) as t from
(select *, row_number() over (partition by slide_id order by score_raw) as rn, count(*) over (partition by slide_id) as n from fx_smart)) group by slide_id, t""", "fx_smart"))
def score_quantile_gate(spark, d):
    q = gates.nearest_rank(scored(spark, d), "score_raw", 0.25, "slide_id", "threshold")
    return rounded(q.groupBy("slide_id", "threshold").agg(F.count_if(F.col("score_raw") >= F.col("threshold")).alias("kept")), "threshold")


@query(oracle("""select slide_id, count(*) filter (ok) as eligible from (select *, qual >= 0.8 or count(*) filter (qual >= 0.8) over (partition by slide_id) < 16 as ok from fx_quality) group by slide_id""", "fx_quality"))
def quality_gate_fallback(spark, d):
    q = gates.quality_gate(score.quality_scores(fx.candidates(spark, d)), 0.8, 16)
    return q.groupBy("slide_id").agg(F.count_if("quality_eligible").alias("eligible"))


def gated_pool(spark, d):
    """Quality scores with stand-ins for the raster scores: technical quality, bed relevance and the artifact penalty."""
    q = score.quality_scores(fx.candidates(spark, d))
    return q.withColumns({"score_v3_base": F.col("score_raw"), "medical_image_quality_score": F.col("technical_quality_score"), "medical_image_utility_score": F.col("tumor_bed_relevance_proxy"), "medical_artifact_penalty": F.col("artifact_penalty_norm")})


POOL = """pool as (select *, score_raw as base, qual as quality, bed as utility, artifact_penalty_norm as artifact from fx_quality),
p1 as (select *, base >= min(case when rn = cast(round_even((n-1)*cast(0.8 as double), 0) as bigint) + 1 then base end) over (partition by slide_id) as base_top from
 (select *, row_number() over (partition by slide_id order by base) as rn, count(*) over (partition by slide_id) as n from pool)),
p2 as (select *, base_top and utility >= min(case when base_top and rm = cast(round_even((m-1)*cast(0.8 as double), 0) as bigint) + 1 then utility end) over (partition by slide_id) as medical_top from
 (select *, row_number() over (partition by slide_id, base_top order by utility) as rm, count(*) filter (base_top) over (partition by slide_id) as m from p1))"""


@query(
    oracle(
        f"""also {POOL},
p3 as (select *, medical_top and quality >= 0.5 and utility >= 0.45 and artifact <= 0.12 as strict_, base_top and quality >= 0.4 and utility >= cast(0.45 as double) - cast(0.10 as double) and artifact <= cast(0.12 as double) + cast(0.05 as double) as relaxed from p2),
p4 as (select *, count(*) filter (strict_) over w as ns, count(*) filter (relaxed) over w as nr, count(*) filter (medical_top) over w as nt from p3 window w as (partition by slide_id)),
p5 as (select *, case when ns < 16 and nr > ns then 'relaxed_thresholds' else 'strict' end as s1, case when ns < 16 and nr > ns then nr else ns end as n1 from p4),
p6 as (select *, case when n1 < 16 and nt > n1 then 'top_v3_medical_pool' else s1 end as s2, case when n1 < 16 and nt > n1 then nt else n1 end as n2 from p5),
p7 as (select *, case when n2 < 16 then 'all_scored_fallback' else s2 end as stage from p6)
select slide_id, stage as eligibility_stage, count(*) filter (case stage when 'strict' then strict_ when 'relaxed_thresholds' then relaxed when 'top_v3_medical_pool' then medical_top else true end) as eligible from p7 group by 1, 2""",
        "fx_quality",
    )
)
def eligibility_cascade(spark, d):
    return gates.cascade(gated_pool(spark, d), 16).groupBy("slide_id", "eligibility_stage").agg(F.count_if("eligible").alias("eligible"))


@query(oracle(f"also {POOL} select slide_id, candidate_id, cast(rk as integer) as rank from (select *, row_number() over (partition by slide_id order by utility desc, base desc, candidate_id) as rk from p2 where medical_top) where rk <= 8", "fx_quality"))
def top_medical(spark, d):
    t = gates.top_utility(gated_pool(spark, d), top_k=8).where("medical_top")
    order = [F.desc("medical_image_utility_score"), F.desc("score_v3_base"), F.col("candidate_id")]
    return select.top_k(t, 8, order).select("slide_id", "candidate_id", "rank")


@query()
def uniform_select(spark, d):
    c = fx.candidates(spark, d)
    return selectors.run("uniform", c, dims(c)).select("slide_id", "candidate_id", "x_level0", "y_level0", "rank")


@query()
def quality_quota(spark, d):
    """Quality gate, score quantile, region round robin, then a fill from the quality pool."""
    c = fx.candidates(spark, d)
    picks = selectors.selected(selectors.run("quality_quota", c, dims(c)), c)
    return rounded(picks.select("slide_id", "candidate_id", "rank", "filename", "score_final"), "score_final")
