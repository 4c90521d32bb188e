"""Reports: shares, reduction, agreement of runs, ratings and weighted kappa, runtimes (R-1 to R-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import count_rows, exact2, share_of_total

QUESTIONS = ("f1", "f2", "f3", "f4")


def parse_status(results: DataFrame) -> DataFrame:
    """R-1."""
    return share_of_total(results, ["status", "parse_mode"])


def reduction(counts: DataFrame) -> DataFrame:
    """R-2: from (rules, canonical, abstract) the reductions in percent; null where there is nothing to reduce."""
    less = lambda a, b: exact2(100.0 * (1 - F.col(b) / F.nullif(F.col(a), F.lit(0))))
    return counts.select("rules", "canonical", "abstract", less("rules", "canonical").alias("pct_canonical"), less("canonical", "abstract").alias("pct_abstract"), less("rules", "abstract").alias("pct_all"))


def stability(runs: list[DataFrame], key: str, value: str) -> DataFrame:
    """R-4: of the keys that all three runs label, how many agree in each pair of runs and in all."""
    named = [r.select(key, F.col(value).alias(f"v{i}")) for i, r in enumerate(runs, 1)]
    x = reduce(lambda a, b: a.join(b, key), named)
    same = {"r1_r2": F.col("v1") == F.col("v2"), "r1_r3": F.col("v1") == F.col("v3"), "r2_r3": F.col("v2") == F.col("v3")}
    same["all_runs"] = same["r1_r2"] & same["r2_r3"]
    got = x.agg(count_rows().alias("total"), *[F.count_if(v).alias(k) for k, v in same.items()])
    return got.select("total", *same, *[exact2(100.0 * F.col(k) / F.nullif(F.col("total"), F.lit(0))).alias(f"pct_{k}") for k in same])


def agreement(labels: DataFrame, key: str, value: str, run: str = "run_id") -> DataFrame:
    """R-4 for any number of runs, in one pass over their rows: of the keys that all runs label, how many agree, by pair of runs and in all (run_a and run_b null).

    One shuffle by key brings the values of a key together, one a run; pairs are made of those (k * (k - 1) / 2 of k runs) and
    summed before the second shuffle.  Runs are few; their number is a scalar of the same rows.  A null value agrees with nothing.
    """
    runs = labels.select(F.count_distinct(run).alias("k"))
    each = labels.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col(run).alias("r"), F.col(value).alias("v")))).alias("x"))
    full = each.filter((F.size("x") == runs.scalar()) & (F.size(F.array_distinct("x.r")) == F.size("x"))).select("x")
    same = "coalesce(x[i].v = x[j].v, false)"
    pairs = f"flatten(transform(sequence(0, size(x) - 1), i -> transform(filter(sequence(0, size(x) - 1), j -> j > i), j -> struct(x[i].r AS run_a, x[j].r AS run_b, {same} AS same))))"
    everyone = "array(struct(CAST(NULL AS STRING) AS run_a, CAST(NULL AS STRING) AS run_b, coalesce(forall(x, y -> y.v = x[0].v), false) AS same))"
    got = full.select(F.inline(F.expr(f"concat({pairs}, {everyone})"))).groupBy("run_a", "run_b").agg(count_rows().alias("total"), F.count_if("same").alias("agree"))
    return got.select("run_a", "run_b", "total", "agree", exact2(100.0 * F.col("agree") / F.col("total")).alias("pct"))


def long_ratings(ratings: DataFrame) -> DataFrame:
    """O-196: (sample_no, evaluator, question, rating)."""
    return ratings.unpivot(["sample_no", "evaluator"], list(QUESTIONS), "question", "rating")


def kappa_pairs(ratings: DataFrame, top: int = 5) -> DataFrame:
    """R-6: linear-weighted kappa of each pair of evaluators for each question of long ratings.

    Observed agreement is the mean weight over the pair's common samples, expected agreement the sum over
    both raters' shares of each rating; ratings that a rater never gave add nothing, so no grid is needed.
    """
    a = ratings.select("sample_no", "question", F.col("evaluator").alias("e1"), F.col("rating").alias("r1"))
    b = ratings.select("sample_no", "question", F.col("evaluator").alias("e2"), F.col("rating").alias("r2"))
    pair = ["question", "e1", "e2"]
    paired = a.join(b, ["sample_no", "question"]).filter("e1 < e2")
    weight = lambda x, y: 1.0 - F.abs(F.col(x) - F.col(y)).cast("double") / (top - 1)
    joint = paired.groupBy(*pair, "r1", "r2").agg(count_rows().alias("n"))  # at most top * top rows a pair from here on
    whole = W.partitionBy(*pair)
    observed = joint.groupBy(*pair).agg((F.sum(weight("r1", "r2") * F.col("n")) / F.sum("n")).alias("p_observed"))

    def marginal(r: str, name: str) -> DataFrame:
        return joint.groupBy(*pair, r).agg(F.sum("n").alias("m")).withColumn(name, F.col("m") / F.sum("m").over(whole)).drop("m")

    expected = marginal("r1", "p1").join(marginal("r2", "p2"), pair).groupBy(*pair).agg(F.sum(weight("r1", "r2") * F.col("p1") * F.col("p2")).alias("p_expected"))
    kappa = (F.col("p_observed") - F.col("p_expected")) / F.nullif(1.0 - F.col("p_expected"), F.lit(0.0))
    return observed.join(expected, pair).withColumn("kappa", kappa)


def rating_grid(ratings: DataFrame, top: int = 5) -> DataFrame:
    """O-157, O-158, O-200: for each pair of evaluators every pair of ratings 1 ... top, with how often it was given, 0 included."""
    a = ratings.select("sample_no", "question", F.col("evaluator").alias("e1"), F.col("rating").cast("int").alias("r1"))
    b = ratings.select("sample_no", "question", F.col("evaluator").alias("e2"), F.col("rating").cast("int").alias("r2"))
    pair = ["question", "e1", "e2"]
    joint = a.join(b, ["sample_no", "question"]).filter("e1 < e2").groupBy(*pair, "r1", "r2").agg(count_rows().alias("n"))
    values = F.sequence(F.lit(1), F.lit(top))  # top * top rows a pair: exploded, not joined
    grid = joint.select(*pair).distinct().withColumn("r1", F.explode(values)).withColumn("r2", F.explode(values))
    return grid.join(joint, [*pair, "r1", "r2"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def kappa_by_question(ratings: DataFrame) -> DataFrame:
    """R-6: the mean over all pairs of evaluators."""
    return kappa_pairs(ratings).groupBy("question").agg(count_rows().cast("int").alias("evaluator_pairs"), exact2(F.avg("kappa")).alias("kappa"))


def _mean_and_high(rating: str) -> list[Column]:
    return [exact2(F.avg(rating)).alias("mean"), exact2(100.0 * F.count_if(F.col(rating) >= 4) / count_rows()).alias("pct_high")]


def dimensions(ratings: DataFrame) -> DataFrame:
    """R-7: mean, share of 4 and 5, and kappa of each question, and a row for all."""
    each = ratings.groupBy("question").agg(*_mean_and_high("rating")).join(kappa_by_question(ratings).drop("evaluator_pairs"), "question", "left")
    total = ratings.agg(*_mean_and_high("rating")).select(F.lit("all").alias("question"), "mean", "pct_high", F.lit(None).cast("double").alias("kappa"))
    return each.unionByName(total)


def by_category(ratings: DataFrame, samples: DataFrame, category: str) -> DataFrame:
    """R-8, R-9: samples and mean rating of each category, over all questions."""
    x = ratings.join(samples.select("sample_no", category), "sample_no")
    return x.groupBy(category).agg(F.count_distinct("sample_no").alias("samples"), exact2(F.avg("rating")).alias("mean"), *[exact2(F.avg(F.when(F.col("question") == q, F.col("rating")))).alias(f"mean_{q}") for q in QUESTIONS])


def rating_counts(ratings: DataFrame) -> DataFrame:
    """C-56 over long ratings."""
    return ratings.agg(F.count_distinct("sample_no").alias("samples"), F.count_distinct("evaluator").alias("evaluators"), F.count_distinct("sample_no", "evaluator").alias("rows"), count_rows().alias("ratings"))


def mean_mismatches(ratings: DataFrame) -> DataFrame:
    """C-57: rows whose stored mean is not the mean of their four ratings."""
    own = F.round((F.col("f1") + F.col("f2") + F.col("f3") + F.col("f4")).cast("decimal(18,6)") / 4, 2).cast("decimal(4,2)")
    return ratings.withColumn("recomputed", own).filter(~F.col("mittelwert").eqNullSafe(F.col("recomputed")))


def runtimes(metrics: DataFrame) -> DataFrame:
    """R-10: runs, least, mean and largest duration of each step; rows of whole jobs are left out (Q-16)."""
    steps = metrics.filter("step_name IS NOT NULL AND step_name <> 'Job'")
    return steps.groupBy("step_name").agg(count_rows().alias("runs"), F.min("duration_ms").alias("min_ms"), exact2(F.avg("duration_ms")).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))


def job_totals(metrics: DataFrame) -> DataFrame:
    """O-182: the counters of a job's steps, summed."""
    steps = metrics.filter("step_name IS NOT NULL AND step_name <> 'Job'")
    return steps.groupBy("job_execution_id").agg(*[F.sum(c).alias(c) for c in ("duration_ms", "read_count", "write_count", "filter_count", "process_skip_count")])
