"""Command line: validate-data, build-labels, build-features, train, score, evaluate, cross-validate."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import SparkSession

from .models import risk
from .operators import metrics, truth
from .operators.panel import top_days
from .plans import experiments, features
from .sources import logs
from .sources.files import write_csv, write_text
from .sources.settings import Settings, load_settings, write_manifest

COMMANDS = ("validate-data", "build-labels", "build-features", "train", "score", "evaluate", "cross-validate")


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    shared.add_argument("--config")
    shared.add_argument("--hash-inputs", action="store_true")
    out = argparse.ArgumentParser(prog="brisk", parents=[shared])
    sub = out.add_subparsers(dest="command", required=True)
    each = {c: sub.add_parser(c, parents=[shared]) for c in COMMANDS}
    each["build-labels"].add_argument("--release", default="r4.2")
    each["build-labels"].add_argument("--early-days", type=int, default=0)
    each["train"].add_argument("--train-end", type=date.fromisoformat, required=True)
    each["train"].add_argument("--model-family")
    each["evaluate"].add_argument("--test-start", type=date.fromisoformat)
    each["evaluate"].add_argument("--alert-k", type=int)
    each["cross-validate"].add_argument("--model-families", default="isolation_forest,lof,ocsvm")
    return out


def _model(s: Settings) -> dict:
    m = s.model
    return {"clusters": m["peer_clusters"], "anomaly_weight": m["anomaly_weight"], "peer_weight": m["peer_weight"], "seed": m["seed"], "trees": m["trees"], "neighbours": m["neighbours"], "nu": m["nu"]}


def run(spark: SparkSession, args: argparse.Namespace, s: Settings) -> None:
    out = s.paths["output"]
    labels = lambda: spark.read.option("header", True).schema("user string, day date, label int").csv(f"{out}/labels.csv")
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    match args.command:
        case "validate-data":
            print(logs.inspect(spark, s.paths["dataset"]).report())
        case "build-labels":
            events = logs.answers(spark, f"{s.paths['dataset']}/answers", args.release)
            write_csv(truth.day_labels(events, args.early_days).orderBy("user", "day"), f"{out}/labels.csv")
            for r in logs.answer_counts(spark, f"{s.paths['dataset']}/answers", args.release).orderBy("source_file").collect():
                print(f"  {r['source_file']}: {r['rows']} rows, {r['bad_rows']} without user or time")
        case "build-features":
            days, model_features = features.build(spark, s)
            days.write.mode("overwrite").parquet(f"{out}/user_days")
            model_features.write.mode("overwrite").parquet(f"{out}/model_features")
        case "train":
            risk.save(risk.fit(table("model_features"), args.train_end, family=args.model_family or s.model["family"], **_model(s)), f"{out}/model")
        case "score":
            risk.score(table("model_features"), risk.load(spark, f"{out}/model")).write.mode("overwrite").parquet(f"{out}/scored")
            top_days(table("scored")).select("user", "day", "risk_score", "top_deviation_feature").show(truncate=False)
        case "evaluate":
            k = s.evaluation["alert_k"] if args.alert_k is None else args.alert_k
            rows = metrics.evaluate_days(table("scored"), labels(), args.test_start, k)
            write_text(spark, f"{out}/metrics.json", json.dumps(rows.first().asDict(), indent=2, sort_keys=True))
        case "cross-validate":
            data = table("model_features").persist()
            folds = experiments.folds_of(data, **s.temporal)
            got = experiments.compare_families(data, labels(), folds, args.model_families.split(","), s.selection, alert_k=s.evaluation["alert_k"], **_model(s))
            write_csv(got.orderBy("fold_id", "family"), f"{out}/folds.csv")
            data.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = load_settings(getattr(args, "config", "config.toml"))
    spark = SparkSession.builder.appName("brisk").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, args, settings)
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql")}
    write_manifest(spark, f"{settings.paths['output']}/runs", args.command, settings.model["seed"], list(settings.paths.values()), conf, getattr(args, "hash_inputs", False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
