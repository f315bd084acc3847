"""Rates, agreement and their relation to other measures, over any frame of labels.

Every function takes the names of its columns. Rates without a denominator are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.correlation import pearson
from quern.functions.numeric import fisher_bound, ratio, wilson
from quern.operators.guards import null_safe_join
from quern.operators.ordering import quantiles, spearman

LABELS = ("REFUSAL", "CORRECT", "HALLUCINATION")


def three_way_summary(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, n_total, n_refusal, n_correct, n_hallucination, n_other, hall_rate with its Wilson interval, hall_rate_answered, hall_rate_unknown).

    Rates of hallucinations: over all, over what was answered, and over what wasn't correct.
    """
    of = lambda x: F.count_if(F.col(label) == x)
    n, (refused, correct, wrong) = F.count(F.lit(1)), map(of, LABELS)
    return df.groupBy(*keys).agg(
        n.alias("n_total"), refused.alias("n_refusal"), correct.alias("n_correct"), wrong.alias("n_hallucination"), (n - refused - correct - wrong).alias("n_other"),
        ratio(wrong, n).alias("hall_rate"), wilson(wrong, n, False).alias("hall_ci_low"), wilson(wrong, n, True).alias("hall_ci_high"),
        ratio(wrong, wrong + correct).alias("hall_rate_answered"), ratio(wrong, wrong + refused).alias("hall_rate_unknown"),
    )


def confusion(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, truth, guess, n) of the pairs that occur."""
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def kappa(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, accuracy, kappa): Cohen's, from the confusion counts; NULL where chance alone agrees always."""
    c = confusion(df, truth, guess, keys)
    side = lambda name: F.struct(F.col(name).alias("label"), *[F.when(F.lit(name == x), F.col("n")).otherwise(0).alias(x) for x in ("truth", "guess")])
    margins = c.select(*keys, F.explode(F.array(side("truth"), side("guess"))).alias("m"), F.lit(0).cast("long").alias("agree"))
    per_label = margins.groupBy(*keys, "m.label").agg(F.sum("m.truth").alias("a"), F.sum("m.guess").alias("b"))
    chance = per_label.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum("a").alias("n"))
    agree = c.groupBy(*keys).agg(F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("agree"))
    both = null_safe_join(chance, agree, keys)
    p, e = F.col("agree") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return both.select(*keys, "n", p.alias("accuracy"), F.try_divide(p - e, 1 - e).alias("kappa"))


def precision_recall(df: DataFrame, truth: str, guess: str, labels: Sequence[str], keys: Sequence[str] = (), on_empty: float | None = None) -> DataFrame:
    """(keys, label, tp, fp, fn, precision, recall, f1) of each of ``labels``, absent ones included; ``on_empty`` stands for 0/0."""
    t, g = F.col(truth), F.col(guess)
    counts = [(F.count_if((t == x) & (g == x)).alias(f"tp{i}"), F.count_if((t != x) & (g == x)).alias(f"fp{i}"), F.count_if((t == x) & (g != x)).alias(f"fn{i}")) for i, x in enumerate(labels)]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")]) for i, x in enumerate(labels)])).alias("m")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.groupBy(*keys).agg(*[c for three in counts for c in three]).select(*keys, each).select(*keys, "m.*").select(
        "*", ratio(tp, tp + fp, on_empty).alias("precision"), ratio(tp, tp + fn, on_empty).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, on_empty).alias("f1")
    )


def core_periphery(df: DataFrame, keys: Sequence[str], value: str, split: str = "split", q: float = 0.5) -> DataFrame:
    """(keys, thr, n_test, mean, mean_core, mean_periphery, core_frac, gap, pos_share_core): core is ``value`` at or above the q-quantile of training rows, measured on test rows."""
    v = F.col(value)
    thr = quantiles(df.where(F.col(split) == "train"), keys, value, {"thr": q}).drop("total")
    core = v >= F.col("thr")
    hi, lo = F.avg(F.when(core, v)), F.avg(F.when(~core, v))
    return null_safe_join(df.where(F.col(split) == "test"), thr, keys).groupBy(*keys, "thr").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(v).alias("mean"), hi.alias("mean_core"), lo.alias("mean_periphery"),
        F.avg(core.cast("int")).alias("core_frac"), (hi - lo).alias("gap"), F.avg(F.when(core, (v > 0).cast("int"))).alias("pos_share_core"),
    )


def related(rates: DataFrame, gains: DataFrame, on: Sequence[str], keys: Sequence[str], rate: str, gain: str, least: int = 3) -> DataFrame:
    """(keys, n, r, r_ci_low, r_ci_high, spearman): how a rate follows a gain over the rows that both have."""
    both = null_safe_join(rates, gains, on).select(*keys, rate, gain).where(F.col(rate).isNotNull() & F.col(gain).isNotNull())
    r = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(gain), F.col(rate), least).alias("r"))
    bound = lambda upper: fisher_bound(F.col("r"), F.col("n"), upper)
    ranked = spearman(both, gain, rate, keys, least).drop("n")
    return null_safe_join(r.select("*", bound(False).alias("r_ci_low"), bound(True).alias("r_ci_high")), ranked, keys)


def sensitivity(default: DataFrame, variants: DataFrame, behaviour: DataFrame, keys: Sequence[str], on: Sequence[str], value: str, behaves: str, least: int = 3) -> DataFrame:
    """(keys, n, r_default, spearman_default, mean_abs_delta, n_behaviour, r_behaviour, spearman_behaviour) of variants of a measure.

    ``keys`` name a variant, ``on`` the rows it shares with the default and with ``behaviour``.
    """
    base = default.select(*on, F.col(value).alias("_base"))
    both = null_safe_join(variants, base, on).where(F.col(value).isNotNull() & F.col("_base").isNotNull())
    met = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_base"), F.col(value), least).alias("r_default"), F.avg(F.abs(F.col(value) - F.col("_base"))).alias("mean_abs_delta"))
    met = null_safe_join(met, spearman(both, "_base", value, keys, least).select(*keys, F.col("spearman").alias("spearman_default")), keys, "left")
    told = null_safe_join(variants, behaviour.select(*on, F.col(behaves).alias("_told")), on).where(F.col(value).isNotNull() & F.col("_told").isNotNull())
    seen = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_behaviour"), pearson(F.col(value), F.col("_told"), least).alias("r_behaviour"))
    seen = null_safe_join(seen, spearman(told, value, "_told", keys, least).select(*keys, F.col("spearman").alias("spearman_behaviour")), keys, "left")
    return null_safe_join(met, seen, keys, "left")


def macro(per_label: DataFrame, keys: Sequence[str] = (), measure: str = "f1") -> DataFrame:
    """Mean of a measure over labels."""
    return per_label.groupBy(*keys).agg(F.avg(measure).alias(f"macro_{measure}"))
