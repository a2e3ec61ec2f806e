"""Gates and cascades that narrow a pool, per slide, with a fall-back when too few are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, value: str, q: float, by: str, name: str, among: Column | None = None) -> DataFrame:
    """Adds the group's quantile as the value at sorted index round((n - 1) * q), halves to even, among some rows."""
    inside = F.lit(True) if among is None else among
    order = Window.partitionBy(by, inside).orderBy(value)
    whole = Window.partitionBy(by)
    ranked = df.withColumn("__r", F.when(inside, F.row_number().over(order))).withColumn("__n", F.count_if(inside).over(whole))
    at = F.bround((F.col("__n") - 1) * F.lit(q), 0) + 1
    return ranked.withColumn(name, F.min(F.when(inside & (F.col("__r") == at), F.col(value))).over(whole)).drop("__r", "__n")


def quality_gate(df: DataFrame, least: float, k: int, by: str = "slide_id") -> DataFrame:
    """Adds quality_eligible: rows of the least quality or more; every row of a group where fewer than k are."""
    good = F.col("technical_quality_score") >= least
    return df.withColumn("quality_eligible", good | (F.count_if(good).over(Window.partitionBy(by)) < k))


#: Thresholds of the cascade.
CASCADE = {"base_quantile": 0.80, "top_quantile": 0.20, "quality": 0.50, "utility": 0.45, "artifact": 0.12, "relax": 0.10, "relax_artifact": 0.05}


def top_utility(df: DataFrame, base: str = "score_v3_base", by: str = "slide_id", top_k: int | None = None, rules: dict[str, float] = CASCADE, enough: int | None = None) -> DataFrame:
    """Adds base_top (base score at its quantile or more) and medical_top (of these, utility at its quantile or more, then the
    first top_k by utility, base score and id). Where medical_top is sure to have ``enough`` rows, those outside base_top go."""
    df = nearest_rank(df, base, rules["base_quantile"], by, "base_threshold")
    df = df.withColumn("base_top", F.col(base) >= F.col("base_threshold"))
    utility_quantile = max(0.0, 1.0 - rules["top_quantile"])
    if enough is not None and (top_k is None or top_k >= enough):
        n = F.count_if(F.col("base_top")).over(Window.partitionBy(by))
        missing = F.count_if(F.col("base_top") & F.col("medical_image_utility_score").isNull()).over(Window.partitionBy(by))
        df = df.withColumns({"__n": n, "__missing": missing})
        sure = (F.col("__missing") == 0) & (F.col("__n") - F.bround((F.col("__n") - 1) * F.lit(utility_quantile), 0) >= enough)
        df = df.where(F.col("base_top") | ~sure).drop("__n", "__missing")
    df = nearest_rank(df, "medical_image_utility_score", utility_quantile, by, "utility_threshold", F.col("base_top"))
    df = df.withColumn("medical_top", F.col("base_top") & (F.col("medical_image_utility_score") >= F.col("utility_threshold")))
    if top_k is not None:
        order = Window.partitionBy(by, "medical_top").orderBy(F.desc("medical_image_utility_score"), F.desc(base), "candidate_id")
        df = df.withColumn("__r", F.row_number().over(order)).withColumn("medical_top", F.col("medical_top") & (F.col("__r") <= top_k)).drop("__r")
    return df


def cascade(df: DataFrame, k: int, base: str = "score_v3_base", by: str = "slide_id", top_k: int | None = None, rules: dict[str, float] = CASCADE, rest: bool = True) -> DataFrame:
    """Adds eligibility_stage of the group and eligible of the row: strict, else relaxed, else the top pool, else all. Without the ``rest``, rows that
    can't become eligible go as soon as that is known."""
    df = top_utility(df, base, by, top_k, rules, None if rest else k)
    q, u, a = F.col("medical_image_quality_score"), F.col("medical_image_utility_score"), F.col("medical_artifact_penalty")
    meets = lambda r, s: (q >= max(0.0, rules["quality"] - r)) & (u >= max(0.0, rules["utility"] - r)) & (a <= min(1.0, rules["artifact"] + s))
    df = df.withColumns({"strict": F.col("medical_top") & meets(0.0, 0.0), "relaxed": F.col("base_top") & meets(rules["relax"], rules["relax_artifact"])})
    w = Window.partitionBy(by)
    df = df.withColumns({f"n_{c}": F.count_if(F.col(c)).over(w) for c in ("strict", "relaxed", "medical_top")})
    after_strict = F.when((F.col("n_strict") < k) & (F.col("n_relaxed") > F.col("n_strict")), F.lit("relaxed_thresholds")).otherwise(F.lit("strict"))
    df = df.withColumn("s1", after_strict).withColumn("n1", F.when(F.col("s1") == "strict", F.col("n_strict")).otherwise(F.col("n_relaxed")))
    to_top = (F.col("n1") < k) & (F.col("n_medical_top") > F.col("n1"))
    df = df.withColumn("s2", F.when(to_top, F.lit("top_v3_medical_pool")).otherwise(F.col("s1"))).withColumn("n2", F.when(to_top, F.col("n_medical_top")).otherwise(F.col("n1")))
    stage = F.when(F.col("n2") < k, F.lit("all_scored_fallback")).otherwise(F.col("s2"))
    df = df.withColumn("eligibility_stage", stage)
    chosen = F.when(F.col("eligibility_stage") == "strict", F.col("strict")).when(F.col("eligibility_stage") == "relaxed_thresholds", F.col("relaxed")).when(F.col("eligibility_stage") == "top_v3_medical_pool", F.col("medical_top")).otherwise(F.lit(True))
    return df.withColumn("eligible", chosen).drop("s1", "s2", "n1", "n2")
