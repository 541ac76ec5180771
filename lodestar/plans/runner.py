"""Session experiments: plan, fit, admit, refresh, predict, score, write."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import metrics, prototypes, splits
from lodestar.plans import model as models
from lodestar.plans import presets, state
from lodestar.plans.config import ABLATIONS, ExperimentConfig, ModelConfig, TinyConfig
from lodestar.sources import tables
from lodestar.sources.commits import Versions

if TYPE_CHECKING:
    from lodestar.sources.configs import RunConfig

Progress = Callable[[str, dict], None]


def _ignore(event: str, payload: dict) -> None:
    """The default listener."""


def labels_of(*parts: DataFrame) -> list[str]:
    """Sorted union of the splits' labels."""
    every = parts[0].select("label")
    for p in parts[1:]:
        every = every.unionByName(p.select("label"))
    return [r["label"] for r in every.distinct().orderBy("label").collect()]


def check_labels(train: DataFrame, held: DataFrame, base: list[str], novel: list[str]) -> None:
    """Base classes are in train and calibration, novel ones in train."""
    have, cal = set(labels_of(train)), set(labels_of(held))
    if missing := sorted((set(base) - have) | (set(base) - cal) | (set(novel) - have)):
        raise ValueError(f"labels without rows: {missing}")


def run_sessions(train: DataFrame, held: DataFrame, test: DataFrame, config: ExperimentConfig, folder: str | None = None, progress: Progress = _ignore) -> tuple[DataFrame, DataFrame]:
    """Base session, then one novel class at a time. Returns all predictions and
    the session metrics; with a folder, writes both."""
    spark = train.sparkSession
    rng = random.Random(config.class_seed)
    base, novel = splits.plan_sessions(labels_of(train, held, test), config.base_ratio, rng.shuffle if config.random_base else None, config.novel_order)
    check_labels(train, held, base, novel)
    only_base = lambda df: df.where(F.col("label").isin(base))
    model = models.fit(only_base(train), only_base(held), config.model)
    predictions, admitted = None, []
    for session in range(len(novel) + 1):
        if session:
            label = novel[session - 1]
            rows = train.where(F.col("label") == label)
            take = splits.shots_of(rows.count(), config.support_share, config.shots)
            support = splits.support(rows, "label", "row_id", take, config.class_seed + session).drop("rank")
            model, outcome = models.admit(model, support)
            if config.model.refresh != "off":
                model = models.refresh(model, support, now=float(session), force=(label,))
            progress("admitted", {"session": session, "label": label, "outcome": outcome[label]})
        found = models.predict(model, test, keep=("label",)).withColumnRenamed("label", "true_label")
        found = models.cut(found.withColumn("session_id", F.lit(session)))
        predictions = found if predictions is None else predictions.unionByName(found)
        admitted += [(s, n) for s in [session] for n in novel[:session]]
        progress("scored", {"session": session})
    known = spark.createDataFrame(admitted, "session_id int, label string")
    scored = metrics.session_metrics(predictions, base, known)
    predictions, scored = predictions.orderBy("session_id", "row_id"), scored.orderBy("session_id")
    if folder:
        tables.write_predictions(predictions, f"{folder}/predictions")
        scored.write.mode("overwrite").parquet(f"{folder}/sessions")
        for session in range(len(novel) + 1):
            tables.write_session(predictions.where(F.col("session_id") == session), scored, folder, session)
        state.write_json(spark, f"{folder}/run", {"base": base, "novel": novel, "config": config, "state": state.metadata(model)})
    return predictions, scored


def run_leave_one_out(train: DataFrame, held: DataFrame, test: DataFrame, config: ExperimentConfig, bursts: list[int], episodes: int | None = None) -> DataFrame:
    """Each class held out in turn and admitted burst by burst: one row for each
    stage with the scorer's rates."""
    out = None
    for episode, novel in enumerate(labels_of(train)[:episodes]):
        known = lambda df, novel=novel: df.where(F.col("label") != novel)
        model = models.fit(known(train), known(held), config.model)
        ranked = models.cut(splits.bursts(train.where(F.col("label") == novel), "label", "row_id", bursts, config.class_seed + episode))
        for stage in range(len(bursts) + 1):
            if stage:
                some = ranked.where(F.col("burst") == stage - 1).drop("rank", "burst")
                model, _ = models.admit(model, some)
                if config.model.refresh != "off":
                    model = models.refresh(model, ranked.where(F.col("burst") < stage).drop("rank", "burst"), now=float(stage), force=(novel,))
            found = models.predict(model, test, keep=("label",)).withColumnRenamed("label", "true_label")
            found = found.withColumns({"episode_id": F.lit(episode), "novel_label": F.lit(novel), "stage": F.lit(stage)})
            part = models.cut(metrics.stage_record(found, ["episode_id", "novel_label", "stage"], F.col("novel_label")))
            out = part if out is None else out.unionByName(part)
    return out


def fit_members(train: DataFrame, held: DataFrame, config: TinyConfig) -> list[models.Model]:
    """One model, or members that differ in their seed, fitted side by side with
    a scheduler pool for each."""
    m = config.experiment.model
    settings = [m.with_(seed=m.seed + i * config.seed_step) for i in range(config.members)]
    return _side_by_side(train.sparkSession, [lambda c=c: models.fit(train, held, c) for c in settings])


def _side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """What all jobs return, run at once; the first error is raised."""
    if len(jobs) == 1:
        return [jobs[0]()]

    def run(i: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"member-{i}")
        return jobs[i]()

    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(jobs))]]


def predict_members(members: list[models.Model], df: DataFrame, how: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predictions of one model, or of all members together from one scan."""
    if len(members) == 1:
        return models.predict(members[0], df, keep=keep)
    rows = models.cut(models.predict_members(members, df, keep=keep))
    found = metrics.ensemble(rows.drop(*keep), "row_id", len(members), how)
    return found.join(rows.where("member = 0").select("row_id", *keep), "row_id") if keep else found


def run_tiny(train: DataFrame, held: DataFrame, test: DataFrame, config: TinyConfig, folder: str | None = None, progress: Progress = _ignore) -> tuple[DataFrame, DataFrame, dict]:
    """Each class held out in turn and admitted burst by burst. Returns stage
    records, episode records and their aggregate; with a folder, writes bursts,
    predictions, records and each episode's state."""
    spark, c = train.sparkSession, config.experiment
    planned = labels_of(train)[: config.episodes]
    stages, episodes, skipped = [], [], []
    for episode, novel in enumerate(planned):
        own = train.where(F.col("label") == novel)
        sizes = own.count()
        reason = None if sizes >= config.least_support and test.where(F.col("label") == novel).limit(1).count() else "too_little_support"
        if reason:
            skipped.append((episode, novel, reason))
            progress("skipped", {"episode": episode, "label": novel, "reason": reason})
            continue
        known = lambda df, novel=novel: df.where(F.col("label") != novel)
        members = fit_members(known(train), known(held), config)
        first = state.snapshot(members if len(members) > 1 else members[0])
        ranked = models.cut(splits.bursts(own, "label", "row_id", list(config.bursts), c.class_seed + episode).where("burst IS NOT NULL"))
        promoted_at, refreshes, since, records = None, 0, 0, []
        for stage in range(len(config.bursts) + 1):
            is_refresh = False
            if stage:
                some = ranked.where(F.col("burst") == stage - 1).drop("rank", "burst")
                changes, every = config.policy(promoted_at is not None)
                members = [models.replace(m, config=m.config.with_(**changes)) for m in members]
                members = _side_by_side(spark, [lambda m=m: models.admit(m, some)[0] for m in members])
                since += 1
                if changes["refresh"] != "off" and since >= every:
                    seen = ranked.where(F.col("burst") < stage).drop("rank", "burst")
                    members = _side_by_side(spark, [lambda m=m: models.refresh(m, seen, now=float(stage), force=(novel,)) for m in members])
                    since, refreshes, is_refresh = 0, refreshes + 1, True
                    if promoted_at is None and any(x == novel and s in (prototypes.STABLE, prototypes.FRAGILE) for m in members for x, s in zip(m.bank.labels, m.bank.status, strict=True)):
                        promoted_at = stage
            found = predict_members(members, test, config.aggregation, ("label",)).withColumnRenamed("label", "true_label")
            found = models.cut(tables.with_ids(found, episode_id=episode, novel_label=novel, stage=stage, is_refresh=is_refresh))
            record = metrics.stage_record(found, ["episode_id", "novel_label", "stage", "is_refresh"], F.col("novel_label"))
            records.append(models.cut(record.withColumn("known_accuracy", F.lit(_known_accuracy(found, novel)))))
            if folder:
                found.write.mode("overwrite").parquet(f"{folder}/stages/episode={episode}/stage={stage}")
            progress("stage", {"episode": episode, "stage": stage, "refresh": is_refresh})
        own_stages = records[0]
        for r in records[1:]:
            own_stages = own_stages.unionByName(r)
        stages.append(own_stages)
        value = metrics.episode_record(own_stages, "episode_id", "stage", "known_accuracy").first()
        final = metrics.last_value(own_stages, "stage", "new_f1")
        episodes.append((episode, novel, float(value["pre"]), float(value["final"]), None if value["after_refresh"] is None else float(value["after_refresh"]), float(value["damage"]), final, metrics.largest_value(own_stages, "new_f1"), promoted_at, int(promoted_at is not None), refreshes, int(min(sizes, sum(config.bursts))), first["prototype_count"]))
        if folder:
            ranked.write.mode("overwrite").partitionBy("burst").parquet(f"{folder}/bursts/episode={episode}")
            state.write_json(spark, f"{folder}/state/episode={episode}", state.metadata(members if len(members) > 1 else members[0]))
    kind = "episode_id int, novel_label string, pre double, final_known_accuracy double, after_refresh_known_accuracy double, damage double, final_new_f1 double, best_new_f1 double, promotion_stage int, promoted int, refreshes int, support_rows int, initial_prototypes int"
    table = spark.createDataFrame(episodes, kind).orderBy("episode_id")
    every = None
    for s in stages:
        every = s if every is None else every.unionByName(s)
    aggregate = metrics.tiny_aggregate(table, len(planned), len(skipped))
    if folder:
        table.write.mode("overwrite").parquet(f"{folder}/episodes")
        if every is not None:
            every.write.mode("overwrite").parquet(f"{folder}/stage_records")
        state.write_json(spark, f"{folder}/aggregate", {**aggregate, "skipped": skipped, "config": config})
    return every, table, aggregate


def _known_accuracy(found: DataFrame, novel: str) -> float:
    """Share of rows of the other classes that are named rightly."""
    row = found.where(F.col("true_label") != novel).agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double"))).first()
    return float(row[0] or 0.0)


CELL = "tag string, status string, seq long, os_hm double, error string"


def sweep_log(spark: SparkSession, folder: str) -> DataFrame:
    """All that a sweep has recorded, failures too: a row for each cell and try."""
    rows = [(c.info["tag"], c.info["status"], c.version, c.info.get("os_hm"), c.info.get("error")) for c in Versions(spark, f"{folder}/log").history()]
    return spark.createDataFrame(rows, CELL)


def run_sweep(cells: dict[str, tuple[DataFrame, DataFrame, DataFrame, ExperimentConfig]], folder: str, spark: SparkSession, parallel: int = 2, limit: float | None = None, write: bool = False) -> DataFrame:
    """Every cell (tag -> splits and settings) that a former run of this folder
    has not finished, `parallel` at a time, each under a job tag and in a
    scheduler pool of its own. Results and failures of any kind are committed
    as they come, so a sweep that was stopped goes on where it was. A cell that
    takes more than `limit` seconds is cancelled, as all are on an interrupt."""
    log, context = Versions(spark, f"{folder}/log"), spark.sparkContext
    done = {c.info["tag"] for c in log.history() if c.info["status"] == "ok"}
    began: dict[str, float] = {}

    def run(tag: str) -> None:
        mark = f"lodestar-{re.sub(r'[^A-Za-z0-9_.-]', '-', tag)}"
        began[mark] = time.monotonic()
        context.addJobTag(mark)
        context.setLocalProperty("spark.scheduler.pool", mark)
        try:
            _, scored = run_sessions(*cells[tag], folder=f"{folder}/cells/{tag}" if write else None)
            told = {"status": "ok", "os_hm": metrics.run_metrics(scored).first()["os_hm"]}
        except Exception as error:  # a cell's failure is a row, whatever it is
            late = limit is not None and time.monotonic() - began[mark] > limit
            told = {"status": "cancelled" if late else "failed", "error": f"{type(error).__name__}: {error}"[:500]}
        finally:
            del began[mark]
            context.removeJobTag(mark)
            context.setLocalProperty("spark.scheduler.pool", None)
        log.record({"tag": tag, **told})

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        waiting = {pool.submit(inheritable_thread_target(spark)(run), tag) for tag in cells if tag not in done}
        try:
            while waiting:
                ended, waiting = wait(waiting, timeout=1.0 if limit is not None else None, return_when=FIRST_COMPLETED)
                for f in ended:
                    f.result()
                for mark, start in list(began.items()):
                    if limit is not None and time.monotonic() - start > limit:
                        context.cancelJobsWithTag(mark)
        except BaseException:
            for f in waiting:
                f.cancel()
            for mark in list(began):
                context.cancelJobsWithTag(mark)
            raise
    return tables.finished(sweep_log(spark, folder))


def summary(found: DataFrame) -> DataFrame:
    """Over the finished seeds of each name and arm (tags `name/arm/seed`): how
    many, mean and standard deviation of the run's score."""
    parts = F.split("tag", "/")
    return found.withColumns({"name": parts[0], "arm": parts[1]}).groupBy("name", "arm").agg(F.count(F.lit(1)).alias("seeds"), F.avg("os_hm").alias("mean"), F.coalesce(F.stddev_samp("os_hm"), F.lit(0.0)).alias("sd")).orderBy("name", "arm")


def arm_of(run: RunConfig, arm: str, seed: int) -> ExperimentConfig:
    """The settings of an arm for a seed of the protocol: the file's own, the one
    published for all data sets, or the one tuned for the set of this name."""
    if arm == "own":
        return replace(run.experiment, class_seed=seed)
    return presets.fixed(seed) if arm == "fixed" else presets.tuned(run.name, seed)


def main(argv: list[str] | None = None) -> None:
    """`python -m lodestar.plans.runner RUN.json [--arms own,fixed,tuned]
    [--seeds 42,43] [--parallel 2]`: the sessions of a run file for each arm and
    seed, and a summary over the seeds. Columns are read by the file's `data`
    section; rows are numbered in file order unless they have a `row_id`."""
    import argparse

    from lodestar.sources.configs import load_run

    given = argparse.ArgumentParser(prog="lodestar")
    given.add_argument("run")
    given.add_argument("--arms", default="own")
    given.add_argument("--seeds", default="")
    given.add_argument("--parallel", type=int, default=2)
    args = given.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    run = load_run(spark, args.run)
    if not run.manifest or not run.output:
        raise ValueError("a run names its manifest and its output")
    if wrong := sorted(set(args.arms.split(",")) - {"own", "fixed", "tuned"}):
        raise ValueError(f"no such arms: {wrong}")
    parts = tables.Manifest.load(spark, run.manifest).read_all(spark, run.data, row_id="row_id")
    splits_ = tuple(models.cut(parts[n]) for n in tables.SPLITS)
    seeds = [int(x) for x in args.seeds.split(",") if x] or [run.experiment.class_seed]
    cells = {f"{run.name}/{arm}/{seed}": (*splits_, arm_of(run, arm, seed)) for arm in args.arms.split(",") for seed in seeds}
    found = run_sweep(cells, run.output, spark, args.parallel, write=True)
    told = summary(found.where(F.col("tag").isin(*cells)))
    told.write.mode("overwrite").parquet(f"{run.output}/summary")
    told.show(truncate=False)


def run_ablation(train: DataFrame, held: DataFrame, test: DataFrame, config: ExperimentConfig) -> DataFrame:
    """Run metrics of every arm; an arm that fails is a row with its error."""
    spark, rows = train.sparkSession, []
    for arm, changes in ABLATIONS.items():
        try:
            model: ModelConfig = config.model.with_(**changes)
            _, scored = run_sessions(train, held, test, replace(config, model=model))
            rows.append((arm, "ok", metrics.run_metrics(scored).first()["os_hm"]))
        except Exception as error:  # an arm's failure is a row
            rows.append((arm, f"{type(error).__name__}: {error}"[:200], None))
    return spark.createDataFrame(rows, "arm string, status string, os_hm double")


if __name__ == "__main__":
    main()
