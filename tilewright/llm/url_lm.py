"""URL filters by rules and, where no rule speaks, by the ratio of two character language models.

Two smoothed variable-order Markov models are counted from the URLs that rules accept and reject. The probability of a
character after a context of k characters mixes its count there with its probability after k - 1 characters, weighted by
``PULL``, down to a uniform one: long contexts speak where they were seen, short ones elsewhere. A URL's score is the mean over its
characters of ln P(accepted) - ln P(rejected), so that length doesn't matter. A fifth of the labelled URLs, by digest, is kept
out of the counts; the threshold is the score that separates these best (most accepted above plus most rejected below).

All in DataFrame functions: a URL is exploded into its (ORDER + 1)-grams, one a character; grams are counted with a
combine before the shuffle; the score of a distinct gram is worked out once, from its suffixes' counts, and joined back to the
exploded grams, where AQE broadcasts a small side or splits hot grams; sums are combined before their shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; a null or empty URL has score 0; with no
labelled URLs on one side the model is uniform there, and without held-out URLs of both kinds the threshold is 0;
verdict is allow at or above the threshold; repeated rows are judged alike; an empty table gives an empty result;
other columns of the input are ignored; URLs of any length are scored whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.shared import keep

#: (verdict, host, path)
Rule = tuple[str, str, str]
ORDER, PULL, ALPHABET = 3, 4.0, 256
#: Scores are placed in bins of this width from -BINS to BINS for the threshold.
BIN, BINS = 0.01, 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two as long, the one with the longer host. Rules are a parameter, a handful."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _grams(urls: DataFrame, columns: list[str]) -> DataFrame:
    """One row a character of ``lm``: the character with the ORDER before it (a start is padded with U+0002). The characters are cut apart once, so a long URL costs in proportion to its length."""
    chars = F.split(F.concat(F.lit("\u0002" * ORDER), "lm"), "")
    zipped = F.arrays_zip(*[F.slice(chars, k + 1, F.length("lm")).alias(f"c{k}") for k in range(ORDER + 1)])
    rows = urls.where("lm <> ''").select(*columns, F.inline(zipped))
    return rows.select(*columns, F.concat(*[F.col(c) for c in rows.columns[len(columns) :]]).alias("g"))


def gram_scores(urls: DataFrame) -> DataFrame:
    """g, ratio of every distinct gram of the table. Counts are of the rows with side 1 (accepted) and 0 (rejected)."""
    counted = _grams(urls, ["side"]).groupBy("g").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 0).alias("r"))
    counted = keep(counted, "grams")
    low = None
    for k in range(ORDER + 1):  # (k + 1)-grams: a context of k characters
        if k == ORDER:
            at = counted
        else:
            at = counted.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substring("g", 1, k)
        seen = counted.groupBy(F.substring("g", ORDER + 1 - k, k).alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        at = at.withColumn("c", context).join(seen, "c")
        if low is None:
            at = at.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
        else:
            at = at.withColumn("s", F.substring("g", 2, k)).join(low, "s")
        p = lambda n, all_, before: (F.col(n) + PULL * F.col(before)) / (F.col(all_) + PULL)
        at = at.select("g", p("a", "na", "pa").alias("pa"), p("r", "nr", "pr").alias("pr"))
        low = at.withColumnRenamed("g", "s")
    return at.select("g", (F.log("pa") - F.log("pr")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, score of every row."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    out = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0
    rows = rows.withColumns({"rule": rule, "said": said, "lm": F.coalesce(after_scheme(F.col("url")), F.col("url"), F.lit("")), "row_id": F.monotonically_increasing_id()})
    rows = keep(rows.withColumn("side", F.when(F.col("said").isNull() | out, F.lit(None)).when(F.col("said") == "allow", 1).otherwise(0).cast("int")).withColumn("apart", out & F.col("said").isNotNull()), "urls")
    ratios = keep(gram_scores(rows), "gram-ratios")  # read again, it is broadcast where small, and else the join can split a hot gram
    sums = _grams(rows, ["row_id"]).join(ratios, "g").groupBy("row_id").agg(F.sum("ratio").alias("total"))
    scored = rows.join(sums, "row_id", "left").withColumn("score", F.round(F.coalesce(F.col("total") / F.length("lm"), F.lit(0.0)), 6))
    scored = keep(scored.drop("total"), "scored-urls")
    threshold = calibrated(scored)
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrated(scored: DataFrame) -> float:
    """The threshold: of the held-out scores' bins, the one from which on to accept so that accepted less rejected shares above are most
    (ties: the least), and halfway down to the next bin that is taken. From at most 2 * BINS + 1 rows of counts."""
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).cast("int")
    bins = scored.where("apart").groupBy(place.alias("bin")).agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") != "allow").alias("r"))
    up, down = Window.orderBy(F.desc("bin")), Window.orderBy("bin")
    all_ = Window.partitionBy()
    gain = F.sum("a").over(up) / F.sum("a").over(all_) - F.sum("r").over(up) / F.sum("r").over(all_)
    bins = bins.withColumns({"na": F.sum("a").over(all_), "nr": F.sum("r").over(all_), "below": F.lag("bin").over(down)}).where("na > 0 and nr > 0")
    best = bins.withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), "bin").select(F.coalesce((F.col("bin") + F.col("below") + 1) / 2, F.col("bin").cast("double")).alias("edge")).first()
    return 0.0 if best is None else best["edge"] * BIN
