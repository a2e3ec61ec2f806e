"""DuckDB text of the derived tables, and helpers that build a query from them."""

from __future__ import annotations

SOURCES = {
    "fx_slides": """select s_suppkey as slide_id,
  cast(case when s_suppkey % 10 = 9 then 900 else 8192 + 1024*(s_suppkey % 17) end as bigint) as slide_width,
  cast(6144 + 512*(s_suppkey % 13) as bigint) as slide_height,
  case when s_suppkey % 7 = 0 then null else cast(0.20 as double) + cast(0.02 as double)*(s_nationkey % 6) end as mpp_x,
  case when s_suppkey % 2 = 0 then '40' else '20' end as objective_power
from supplier""",
    "fx_cand": """select l_suppkey as slide_id, l_partkey as part,
  concat('candidate_', lpad(cast(l_partkey as varchar), 6, '0')) as candidate_id,
  cast((l_partkey % 40)*1024 as bigint) as x_level0,
  cast((l_partkey // 40)*1024 as bigint) as y_level0,
  cast(1024 as bigint) as patch_size,
  max(l_quantity)/cast(50.0 as double) as tissue_ratio, max(l_discount)*cast(10.0 as double) as nuclear_signal,
  max(l_tax)/cast(0.08 as double) as visual_entropy, max(l_extendedprice) as blur_score, min(l_discount) as artifact_penalty
from lineitem group by l_suppkey, l_partkey""",
    "fx_dims": """select slide_id, cast(40*1024 as bigint) as slide_width, max(y_level0)+1024 as slide_height from fx_cand group by slide_id""",
    "fx_norm": """select c.*, {norms} from fx_cand c join (select slide_id, {ends} from fx_cand group by slide_id) e using (slide_id)""",
    "fx_smart": """select *, cast(0.35 as double)*tissue_ratio_norm + cast(0.25 as double)*nuclear_signal_norm + cast(0.15 as double)*visual_entropy_norm + cast(0.15 as double)*blur_score_norm + cast(-0.10 as double)*artifact_penalty_norm as score_raw from fx_norm""",
    "fx_quality": """select *, {clip_useful} as score_raw, case
    when low >= greatest(resid, het, qual) then 'low_cellularity_treated_bed_proxy'
    when resid >= greatest(low, het, qual) then 'residual_candidate_proxy'
    when het >= greatest(low, resid, qual) then 'heterogeneity' else 'balanced_quality' end as usefulness_reason
  from (select *, {clip_bed} as bed from
  (select *, {clip_resid} as resid, {clip_low} as low from
  (select *, {clip_cell} as cell, {clip_qual} as qual, {clip_het} as het from fx_norm)))""",
    "fx_region": """select s.*, d.slide_width, d.slide_height,
  greatest(0, least(3, cast(floor((y_level0 + patch_size/2.0)/d.slide_height*4) as integer))) as region_row,
  greatest(0, least(3, cast(floor((x_level0 + patch_size/2.0)/d.slide_width*4) as integer))) as region_col
from fx_smart s join fx_dims d using (slide_id)""",
    "fx_regions": """select *, concat('r', region_row, '_c', region_col) as region_id from fx_region""",
    "fx_runs": """select 'baseline' as method, slide_id, candidate_id, x_level0, y_level0, patch_size, score_raw, cast(rk as integer) as rank from
  (select *, row_number() over (partition by slide_id order by (part*7919 + slide_id*104729) % 10007, candidate_id) as rk from fx_smart) where rk <= 16
union all select 'smart', slide_id, candidate_id, x_level0, y_level0, patch_size, score_raw, cast(rk as integer) from
  (select *, row_number() over (partition by slide_id order by score_raw desc, candidate_id) as rk from fx_smart) where rk <= 16""",
    "fx_mask": """select slide_id, tx, ty, cast((tx*7 + ty*13 + slide_id*31) % 11 < 6 as integer) as tissue from
  (select slide_id, unnest(range(cast(ceil(slide_width/256) as bigint))) as tx, slide_height from fx_slides) a,
  lateral (select unnest(range(cast(ceil(a.slide_height/256) as bigint))) as ty)""",
    "fx_embed": """select vec_id, concat('candidate_', lpad(cast(vec_id as varchar), 6, '0')) as candidate_id, vec_id % 25 * 1024 as x_level0, vec_id // 25 * 1024 as y_level0, label as cluster_id,
  list_transform(embedding, lambda v: cast(v as double)) as embedding from embeddings""",
    "fx_unit": """select * exclude (embedding, n), list_transform(embedding, lambda v: v/n) as unit from
  (select *, sqrt(list_sum(list_transform(embedding, lambda v: v*v))) as n from fx_embed)""",
    "fx_long": """select vec_id, p - 1 as p, cast(embedding[p] as double) as v from embeddings, lateral (select unnest(range(1, 65)) as p)""",
    "fx_pixels": """select vec_id // 3 as tile_id, p // 8 as y, p % 8 as x,
  max(case when vec_id % 3 = 0 then q end) as r, max(case when vec_id % 3 = 1 then q end) as g, max(case when vec_id % 3 = 2 then q end) as b
from (select *, cast(least(255, greatest(0, floor((v - cast(-0.4 as double))/cast(0.8 as double)*255))) as integer) as q from fx_long) group by 1, 2, 3 having count(*) = 3""",
    "fx_px": """select *, (r+g+b)/cast(765.0 as double) as bright, (greatest(r,g,b)-least(r,g,b))/cast(255.0 as double) as sat,
  (cast(0.299 as double)*r + cast(0.587 as double)*g + cast(0.114 as double)*b)/255.0 as grey,
  (r+g+b)/3.0 < 235 and sqrt(((r*r+g*g+b*b)/cast(3.0 as double)) - ((r+g+b)/cast(3.0 as double))*((r+g+b)/cast(3.0 as double))) > 8 as tissue,
  greatest(0, {h}) as hem, greatest(0, {e}) as eos from fx_pixels""",
    "fx_labels": """select vec_id // 2 as mask_id, p // 8 as y, p % 8 as x,
  max(case when vec_id % 2 = 0 then q end) as y_true, max(case when vec_id % 2 = 1 then q end) as y_pred
from (select *, cast(least(4, greatest(0, floor((v - cast(-0.4 as double))/cast(0.8 as double)*5))) as integer) as q from fx_long) group by 1, 2, 3 having count(*) = 2""",
    "fx_probs": """select cube_id, y, x, cast(class as integer) as class, e/sum(e) over (partition by cube_id, y, x) as p from
  (select vec_id // 5 as cube_id, p // 8 as y, p % 8 as x, vec_id % 5 as class, exp(8*v) as e, count(*) over (partition by vec_id // 5, p) as n from fx_long) where n = 5""",
    "fx_seg": """select event_id as row_id, case when event_id % 2 = 0 then 'baseline' else 'smart' end as method,
  case when event_type = 'error' then 'failed' when event_type = 'signup' then 'skipped' else 'completed' end as status, value as runtime_seconds,
  cast(event_id % 5 as varchar) as k1, cast(floor(value*10) as bigint) as n1, cast((event_id + 1 + event_id % 3) % 5 as varchar) as k2, cast(regexp_replace(props, '[^0-9]', '', 'g') as bigint) as n2,
  case when event_id % 4 = 0 then 512*512 else 1024*1024 end as pixels, event_id % 3 = 0 as resized, event_id % 3 as w from events""",
}

FEATURES = ["tissue_ratio", "nuclear_signal", "visual_entropy", "blur_score", "artifact_penalty"]
NEEDS = {
    "fx_dims": ["fx_cand"],
    "fx_norm": ["fx_cand"],
    "fx_smart": ["fx_norm"],
    "fx_quality": ["fx_norm"],
    "fx_region": ["fx_smart", "fx_dims"],
    "fx_regions": ["fx_region"],
    "fx_runs": ["fx_smart"],
    "fx_mask": ["fx_slides"],
    "fx_unit": ["fx_embed"],
    "fx_pixels": ["fx_long"],
    "fx_px": ["fx_pixels"],
    "fx_labels": ["fx_long"],
    "fx_probs": ["fx_long"],
}


def _clip(x: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), {x}))"


def _fill() -> dict[str, str]:
    import numpy as np

    from tilewright.functions.raster import STAINS

    norm = lambda c: f"case when {c} is null or abs({c}_hi - {c}_lo) <= 1e-12 then cast(0.5 as double) else {_clip(f'({c} - {c}_lo)/({c}_hi - {c}_lo)')} end as {c}_norm"
    d = "cast({} as double)".format
    m = np.array(STAINS)
    u = np.linalg.pinv(m / np.linalg.norm(m, axis=1, keepdims=True))
    density = lambda c: " + ".join(f"(-ln(greatest(cast(1e-6 as double), {p}/255.0)))*cast({u[i, c]!r} as double)" for i, p in enumerate("rgb")).replace("np.float64(", "(")
    cell, qual, het, quiet = "cell", "qual", "het", f"({d(1)} - artifact_penalty_norm)"
    return {
        "norms": ", ".join(map(norm, FEATURES)),
        "ends": ", ".join(f"min({c}) as {c}_lo, max({c}) as {c}_hi" for c in FEATURES),
        "clip_cell": _clip(f"{d(0.7)}*nuclear_signal_norm + {d(0.3)}*nuclear_signal_norm"),
        "clip_qual": _clip(f"tissue_ratio_norm*{d(0.42)} + blur_score_norm*{d(0.28)} + {quiet}*{d(0.20)} + {d(0.5)}*{d(0.10)}"),
        "clip_het": _clip("visual_entropy_norm"),
        "clip_resid": _clip(f"{cell}*{d(0.45)} + {het}*{d(0.30)} + {qual}*{d(0.25)}"),
        "clip_low": _clip(f"{qual}*(tissue_ratio_norm*{d(0.55)} + {het}*{d(0.25)} + {quiet}*{d(0.20)})*({d(1)} - {cell}*{d(0.75)})"),
        "clip_bed": _clip(f"qual*{d(0.32)} + resid*{d(0.28)} + low*{d(0.25)} + het*{d(0.15)}"),
        "clip_useful": _clip(f"{d(0.30)}*qual + {d(0.22)}*resid + {d(0.18)}*low + {d(0.20)}*bed + {d(0.10)}*het + {d(-0.10)}*artifact_penalty_norm"),
        "h": density(0),
        "e": density(1),
    }


def r6(x: str) -> str:
    """Rounded as the queries round, without a negative zero."""
    return f"(round({x}, 6) + 0.0)"


clip = _clip


def oracle(body: str, *needs: str, recursive: bool = False) -> str:
    """The query with the derived tables it names and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    fill = _fill()
    text = {n: SOURCES[n] for n in order}
    for n in text:
        for k, v in fill.items():
            text[n] = text[n].replace("{" + k + "}", v)
    ctes = ",\n".join(f"{n} as ({text[n]})" for n in order)
    head = "with recursive " if recursive else "with "
    return f"{head}{ctes}{',' if body.lstrip().startswith('also ') else ''}\n{body.lstrip().removeprefix('also ')}" if ctes else body
