"""Open-set, incremental and run-level metrics as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.labels import UNKNOWN, harmonic, ratio
from lodestar.operators.running import ranked, running


def _share(hit: Column, of: Column) -> Column:
    """Share of `hit` among rows where `of`, 0 without any."""
    return ratio(F.sum((hit & of).cast("double")), F.sum(of.cast("double")))


def known_flags(pred: DataFrame, base: list[str], admitted: DataFrame | None = None, session: str = "session_id") -> DataFrame:
    """Add `known`: the true label is a base class or admitted by its session.

    admitted: session, label. Without it only base classes are known."""
    low = pred.withColumn("_t", F.lower("true_label")).withColumn("_p", F.lower("predicted_label"))
    is_base = F.col("_t").isin([b.lower() for b in base]) if base else F.lit(False)
    if admitted is None:
        return low.withColumn("known", is_base)
    some = admitted.select(F.col(session), F.lower("label").alias("_t")).distinct().withColumn("_a", F.lit(True))
    return low.join(some, [session, "_t"], "left").withColumn("known", is_base | F.coalesce("_a", F.lit(False))).drop("_a")


def session_metrics(pred: DataFrame, base: list[str], admitted: DataFrame | None = None, session: str = "session_id", digits: int = 4) -> DataFrame:
    """Each session's n_samples, n_true_known, n_true_unknown, ccr, tur, os_hm,
    f1_unknown and macro_f1_with_unknown (mean over known classes and unknown)."""
    rows = known_flags(pred, base, admitted, session).withColumn("_c", F.when(F.col("known"), F.col("_t")).otherwise(UNKNOWN))
    known, rejected = F.col("known"), F.col("_p") == UNKNOWN
    tp, fp, fn = (F.sum(x.cast("double")) for x in (rejected & ~known, rejected & known, ~rejected & ~known))
    plain = rows.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(known.cast("long")).alias("n_true_known"),
        F.sum((~known).cast("long")).alias("n_true_unknown"),
        _share(F.col("_p") == F.col("_t"), known).alias("ccr"),
        _share(rejected, ~known).alias("tur"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_unknown"),
    )
    # One row for each class and session: true, predicted and hit counts.
    sided = rows.select(session, F.explode(F.array(F.struct(F.col("_c").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("_p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("_c") == F.col("_p")).alias("hit"))
    counts = sided.groupBy(session, F.col("s.c").alias("c")).agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum((F.col("hit") & (F.col("s.t") == 1)).cast("long")).alias("tp"))
    sessions = plain.select(session)
    spark = pred.sparkSession
    always = spark.createDataFrame([(b.lower(),) for b in sorted(set(base))] + [(UNKNOWN,)], "c string")
    classes = sessions.crossJoin(F.broadcast(always))  # the base classes, a few rows
    if admitted is not None:
        classes = classes.unionByName(admitted.select(session, F.lower("label").alias("c"))).distinct()
    f1 = classes.join(counts, [session, "c"], "left").groupBy(session).agg(F.avg(ratio(2 * F.coalesce("tp", F.lit(0)), F.coalesce("t", F.lit(0)) + F.coalesce("p", F.lit(0)))).alias("macro_f1_with_unknown"))
    out = plain.join(f1, session).withColumn("os_hm", harmonic(F.col("ccr"), F.col("tur")))
    return out.select(session, "n_samples", "n_true_known", "n_true_unknown", *(F.round(c, digits).alias(c) for c in ("ccr", "tur", "os_hm", "f1_unknown", "macro_f1_with_unknown")))


def run_metrics(sessions: DataFrame, digits: int = 4) -> DataFrame:
    """Means of the sessions' rounded values over those with unknown rows."""
    return sessions.where("n_true_unknown > 0").agg(*(F.round(F.avg(c), digits).alias(c) for c in ("os_hm", "ccr", "tur", "f1_unknown", "macro_f1_with_unknown")))


def auroc(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; rows of equal score are summed
    first, and the order of scores is spread over tasks."""
    tied = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.sum((~F.col(positive)).cast("double")).alias("n"))
    run = running(tied, keys, [F.col(score)], {"b": F.col("n")}).withColumn("b", F.col("b") - F.col("n"))
    return run.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auroc"))


def aupr(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score weighted by the
    recall gained there."""
    tied = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("m"))
    run = running(tied, keys, [F.desc(score)], {"tp": F.col("p"), "k": F.col("m")})
    return run.groupBy(*keys).agg((F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("aupr"))


def confusion(df: DataFrame, keys: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return df.groupBy(*keys, F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def mcc(df: DataFrame, keys: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """Multi-class correlation from the confusion table; 0 if a side is constant."""
    cells = confusion(df, keys, true, predicted).withColumn("n", F.col("n").cast("double"))
    by_true = cells.groupBy(*keys, F.col("t").alias("c")).agg(F.sum("n").alias("a"))
    by_pred = cells.groupBy(*keys, F.col("p").alias("c")).agg(F.sum("n").alias("b"))
    sums = by_true.join(by_pred, [*keys, "c"], "full").groupBy(*keys).agg(F.sum(F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    all_ = cells.groupBy(*keys).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    both = all_.join(sums, keys) if keys else all_.crossJoin(sums)
    s = F.col("s")
    return both.select(*keys, ratio(F.col("c") * s - F.col("ab"), F.sqrt(s * s - F.col("bb")) * F.sqrt(s * s - F.col("aa"))).alias("mcc"))


def macro_f1(df: DataFrame, keys: list[str], classes: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """Mean F1 over `classes` (one column c), 0 for a class without any row."""
    cells = confusion(df, keys, true, predicted)
    by_true = cells.groupBy(*keys, F.col("t").alias("c")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("h"))
    by_pred = cells.groupBy(*keys, F.col("p").alias("c")).agg(F.sum("n").alias("b"))
    joined = by_true.join(by_pred, [*keys, "c"], "full").join(F.broadcast(classes), "c")
    n = classes.count()
    return joined.groupBy(*keys).agg((F.sum(ratio(2.0 * F.coalesce("h", F.lit(0)), F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))) / n).alias("macro_f1"))


def rejection_score(pred: DataFrame) -> Column:
    """score / threshold; a threshold of 0 counts as the least double step."""
    t = F.col("threshold").try_cast("double")
    return F.col("score").try_cast("double") / F.when(t == 0, F.lit(2.220446049250313e-16)).otherwise(t)


def summary(pred: DataFrame, known: list[str]) -> DataFrame:
    """One row: counts, accuracies, macro-F1, correlation, reject rates, AUROC
    and AUPR of rejection; measures without any row to judge are null."""
    rows = pred.withColumn("known", F.col("true_label").isin(known)).withColumn("r", F.round(rejection_score(pred), 9))
    k, a, c = F.col("known"), F.col("accepted"), F.col("true_label") == F.col("predicted_label")
    share = lambda hit, of: F.sum((hit & of).cast("double")) / F.nullif(F.sum(of.cast("double")), F.lit(0.0))
    plain = rows.agg(
        F.sum(a.cast("long")).alias("accepted_count"),
        F.sum((~a).cast("long")).alias("rejected_count"),
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.avg(((k & a & c) | (~k & ~a)).cast("double")), F.lit(0.0)).alias("overall_open_set_accuracy"),
        share(c, a).alias("accepted_accuracy"),
        share(c, k).alias("known_class_accuracy"),
        share(~a, ~k).alias("unknown_rejection_rate"),
        share(a, ~k).alias("false_known_rate"),
    )
    classes = pred.sparkSession.createDataFrame([(x,) for x in sorted(set(known))], "c string")
    ranked = rows.select((~k).alias("unknown"), "r")
    only = rows.where(k)
    for part in (macro_f1(only, [], classes).withColumnRenamed("macro_f1", "known_macro_f1"), mcc(only, []).withColumnRenamed("mcc", "known_mcc"), auroc(ranked, [], "unknown", "r").withColumnRenamed("auroc", "unknown_rejection_auroc"), aupr(ranked, [], "unknown", "r").withColumnRenamed("aupr", "unknown_rejection_aupr")):
        plain = plain.join(F.broadcast(part), how="left")  # each is one row
    return plain


def session_record(pred: DataFrame, base: list[str], novel_so_far: DataFrame, session: str = "session_id") -> DataFrame:
    """Incremental record of each session: accuracy over all known, base and
    novel rows, their harmonic mean, and reject rate of unknown ones."""
    rows = known_flags(pred, base, novel_so_far, session)
    is_base, hit = F.col("_t").isin([b.lower() for b in base]), F.col("_p") == F.col("_t")
    out = rows.groupBy(session).agg(_share(hit, F.col("known")).alias("overall_accuracy"), _share(hit, is_base).alias("base_accuracy"), _share(hit, F.col("known") & ~is_base).alias("novel_accuracy"), _share(F.col("_p") == UNKNOWN, ~F.col("known")).alias("unknown_rejection_rate"))
    return out.withColumn("harmonic_mean", harmonic(F.col("base_accuracy"), F.col("novel_accuracy")))


def run_summary(records: DataFrame, session: str = "session_id", value: str = "overall_accuracy") -> DataFrame:
    """First and last value, mean over novel sessions, and the relative drop."""
    return records.agg(F.min_by(value, session).alias("first"), F.max_by(value, session).alias("last"), F.avg(F.when(F.col(session) > 0, F.col(value))).alias("mean_novel"), F.count(F.lit(1)).alias("sessions")).withColumn("dropping_rate", ratio(F.col("first") - F.col("last"), F.col("first")))


def stage_record(pred: DataFrame, keys: list[str], new_label: Column) -> DataFrame:
    """Rates of provisional and fragile acceptance and precision, recall and F1
    of the new class, by stage."""
    new, said = F.col("true_label") == new_label, F.col("predicted_label") == new_label
    tp, a, b = F.sum((new & said).cast("double")), F.sum(new.cast("double")), F.sum(said.cast("double"))
    status = F.col("best_prototype_status")
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("accepted") & (status == "provisional")).cast("double")).alias("provisional_rate"),
        F.avg((F.col("accepted") & (status == "fragile_stable")).cast("double")).alias("fragile_rate"),
        ratio(tp, b).alias("new_precision"),
        ratio(tp, a).alias("new_recall"),
        ratio(2 * tp, a + b).alias("new_f1"),
    )


def episode_record(stages: DataFrame, episode: str, order: str, value: str) -> DataFrame:
    """Value before, at the end and after the last refresh, and the damage."""
    return stages.groupBy(episode).agg(F.min_by(value, order).alias("pre"), F.max_by(value, order).alias("final"), F.max_by(F.when(F.col("is_refresh"), F.col(value)), F.when(F.col("is_refresh"), F.col(order))).alias("after_refresh"), F.count(F.lit(1)).alias("stages")).withColumn("damage", F.col("final") - F.col("pre"))


def vote(pred: DataFrame, key: str, member: str, label: str = "predicted_label") -> DataFrame:
    """Each row's most frequent label over ensemble members, the smaller of ties."""
    counted = pred.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("votes"))


def ensemble(pred: DataFrame, key: str, members: int, how: str = "average") -> DataFrame:
    """One row for each key from the members' (member, predicted_label, accepted,
    score, threshold, best_class_label, best_prototype_id, best_prototype_status,
    projection_version): the mean or largest score against the mean threshold,
    or a majority of rejects. An accepted row takes the label that most of the
    members that accept give, the one of the first member of ties, and is told
    with that member's prototype; a rejected one with that of the least score."""
    rejects = F.sum((~F.col("accepted")).cast("long"))
    score = {"average": F.avg("score"), "max": F.max("score"), "majority": rejects.cast("double")}[how]
    limit = F.lit(float(members // 2)) if how == "majority" else F.avg("threshold")
    totals = pred.groupBy(key).agg(score.alias("score"), limit.alias("threshold"), F.max("projection_version").alias("projection_version"), F.max(F.col("accepted").cast("int")).alias("_some")).withColumn("accepted", F.col("score") <= F.col("threshold"))
    told = pred.select(key, "member", "predicted_label", F.col("accepted").alias("_a"), F.col("score").alias("_s"), "best_class_label", "best_prototype_id", "best_prototype_status").join(totals, key)
    counts = (F.col("accepted") & ((F.col("_some") == 0) | F.col("_a"))) & (F.col("predicted_label") != UNKNOWN)
    best = F.struct("member", "best_class_label", "best_prototype_id", "best_prototype_status")
    votes = told.where(counts).groupBy(key, "predicted_label").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("m"), F.min(best).alias("by"))
    chosen = votes.groupBy(key).agg(F.min_by(F.struct("predicted_label", "by"), F.struct(-F.col("n"), "m")).alias("c"))
    least = told.groupBy(key).agg(F.min_by(best, F.struct("_s", "member")).alias("by"))
    out = totals.join(least, key).join(chosen, key, "left")
    by = F.coalesce("c.by", "by")
    return out.select(key, F.coalesce("c.predicted_label", F.lit(UNKNOWN)).alias("predicted_label"), "accepted", by["best_class_label"].alias("best_class_label"), by["best_prototype_id"].alias("best_prototype_id"), by["best_prototype_status"].alias("best_prototype_status"), "score", "threshold", "projection_version")


def last_value(df: DataFrame, order: str, value: str) -> object:
    """The value of the last row, none without rows."""
    row = df.orderBy(F.desc(order)).select(value).first()
    return row[0] if row else None


def largest_value(df: DataFrame, value: str) -> float | None:
    """The largest of the values that are numbers, none without any."""
    return df.agg(F.max(F.col(value).try_cast("double"))).first()[0]


def tiny_aggregate(episodes: DataFrame, planned: int, skipped: int) -> dict[str, object]:
    """Counts, means over episodes that have the value, and totals. Columns of a
    mean carry its name; promoted, refreshes and support_rows are summed."""
    given = [c for c in episodes.columns if c.startswith(("final_", "mean_", "after_refresh", "damage", "promotion_"))]
    number = lambda c: F.col(c).try_cast("double")
    sums = {c: F.coalesce(F.sum(number(c)), F.lit(0.0)).cast("long") for c in ("promoted", "refreshes", "support_rows") if c in episodes.columns}
    row = episodes.agg(F.count(F.lit(1)).alias("_n"), *(F.avg(number(c)).alias(f"mean_{c}") for c in given), *(v.alias(f"total_{c}") for c, v in sums.items())).first().asDict()
    n = row.pop("_n")
    return {"episode_count": n, "planned_episode_count": planned, "skipped_episode_count": skipped, **{k: v for k, v in row.items() if v is not None and n}}


def seeds(df: DataFrame, dataset: str, value: str) -> DataFrame:
    """Mean with population and sample deviation over seeds."""
    return df.groupBy(dataset).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"), F.count(F.lit(1)).alias("seeds"))


def ablation(df: DataFrame, arm: str, value: str, full: str) -> DataFrame:
    """Mean of each arm and its difference from the full one."""
    means = df.groupBy(arm).agg(F.avg(value).alias("mean"))
    whole = means.where(F.col(arm) == full).select(F.col("mean").alias("_f"))
    return means.crossJoin(F.broadcast(whole)).select(arm, "mean", (F.col("mean") - F.col("_f")).alias("delta"))  # one row on the right


def holm(df: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p values over one family of tests, its order spread
    over tasks."""
    m = df.count()
    order = [F.col(p), F.col(key)]
    placed = ranked(df.select(key, p), [], order)
    step = F.least(F.lit(1.0), F.col(p) * (m - F.col("rank") + 1))
    run = running(placed, [], order, maxima={"holm_p": step})
    return run.select(key, p, F.col("rank").cast("int").alias("rank"), "holm_p", (F.col("holm_p") < alpha).alias("significant"))


def session_deltas(df: DataFrame, keys: list[str], session: str, value: str) -> DataFrame:
    """Change from the session before and from the first one."""
    w = Window.partitionBy(*keys).orderBy(session)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("since_first", F.col(value) - F.first(value).over(w))


def static_aggregate(episodes: DataFrame, means: list[str], sums: list[str]) -> DataFrame:
    """Means and sums of columns that may hold text; what is no number counts
    as missing in means and as 0 in sums."""
    as_number = lambda c: F.col(c).try_cast("double")
    return episodes.agg(F.count(F.lit(1)).alias("episode_count"), *(F.avg(as_number(c)).alias(f"mean_{c}") for c in means), *(F.sum(F.coalesce(as_number(c), F.lit(0.0))).alias(f"sum_{c}") for c in sums))


def significance(runs: DataFrame, keys: list[str], method: str, seed: str, value: str, ours: str) -> DataFrame:
    """Each other method against `ours` on the same seeds: means, difference,
    paired t and signed-rank p, seeds won, and the step-down adjusted p over the
    family. A group holds one row for each seed."""
    import pandas as pd

    from lodestar.functions.statistics import paired_t, wilcoxon

    mine = runs.where(F.col(method) == ours).select(*keys, seed, F.col(value).alias("_ours"))
    pairs = runs.where(F.col(method) != ours).join(mine, [*keys, seed]).select(*keys, method, seed, "_ours", F.col(value).alias("_theirs"))
    by = [*keys, method]

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["_ours"].to_numpy(float), rows["_theirs"].to_numpy(float)
        return pd.DataFrame([[*(rows[k].iloc[0] for k in by), a.mean(), b.mean(), a.mean() - b.mean(), paired_t(a, b)[1], wilcoxon(a, b), int((a > b).sum())]], columns=[*by, "ours", "theirs", "delta", "paired_t_p", "wilcoxon_p", "seeds_won"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in by)
    tested = pairs.groupBy(*by).applyInPandas(test, f"{kinds}, ours double, theirs double, delta double, paired_t_p double, wilcoxon_p double, seeds_won long")
    named = tested.withColumn("_key", F.concat_ws("|", *by))
    adjusted = holm(named.select("_key", "paired_t_p"), "_key", "paired_t_p").select("_key", "holm_p", "significant")
    return named.join(adjusted, "_key").drop("_key")
