"""Command line: ``python -m chronofold convert | audit | materialize | train | evaluate | check |
compare | fit | score | explain`` over a folder of tables."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chronofold", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="CSV files of a folder to validated Parquet")
    convert.add_argument("source")
    convert.add_argument("target")
    for name, text in (("fit", "fit and save a model with its manifest"), ("score", "scores of all events by a saved model"), ("explain", "Shapley values of a saved model's features")):
        p = sub.add_parser(name, help=text)
        p.add_argument("tables")
        p.add_argument("model")
        if name == "score":
            p.add_argument("target")
        if name == "fit":
            p.add_argument("--contract", type=int, default=17, choices=(17, 25, 30))
            p.add_argument("--learner", default="gbt", choices=("logistic", "gbt"))
            p.add_argument("--against", help="the model in place")
    for name, text in (("audit", "the temporal audit of the events"), ("materialize", "the feature table"), ("train", "fit, score and evaluate"), ("compare", "two contracts, metric by metric"), ("evaluate", "boosted trees by split, quarter, bin and gain"), ("check", "a feature table against its events")):
        p = sub.add_parser(name, help=text)
        p.add_argument("tables")
        if name in ("materialize", "check"):
            p.add_argument("target")
        p.add_argument("--contract", type=int, default=17, choices=(17, 25, 30))
        p.add_argument("--learner", default="logistic", choices=("logistic", "gbt"))
    a = parser.parse_args(args)

    from . import views
    from .session import session

    spark = session()
    if a.command == "convert":
        import os

        from .schemas import DATASETS
        from .sources.publish import convert_all
        from .sources.scan import read_csv

        found = {n: read_csv(spark, f"{a.source}/{n}.csv", d) for n, d in DATASETS.items() if os.path.exists(f"{a.source}/{n}.csv")}
        convert_all(spark, found, a.target).show(truncate=False)
    elif a.command == "audit":
        from .operators.explore import temporal_audit

        temporal_audit(views.events(spark, a.tables)).show(vertical=True, truncate=False)
    elif a.command == "materialize":
        from .plans.materialize import materialize

        print(materialize(views.events(spark, a.tables), views.catalog(spark, a.tables), views.scores(spark, a.tables), a.target, a.contract))
    elif a.command == "train":
        from .model.train import fit_and_evaluate

        fit_and_evaluate(spark, a.tables, a.contract, a.learner).show(truncate=False)
    elif a.command == "evaluate":
        from .model.train import fit_and_evaluate_trees

        fit_and_evaluate_trees(spark, a.tables, a.contract).show(1000, truncate=False)
    elif a.command == "check":
        import json

        from .operators.artifacts import check_artifact
        from .sources.publish import Files

        side = json.loads(Files(spark, a.target).read(f"{a.target}.json"))
        check_artifact(spark.read.parquet(a.target), views.events(spark, a.tables), side["contract"], side["source"])
        print("valid")
    elif a.command == "fit":
        from .model import manifest

        old = manifest.read(spark, f"{a.against}.json") if a.against else None
        print(manifest.dumps(manifest.publish_model(spark, a.tables, a.model, a.contract, a.learner, a.model.rstrip("/").split("/")[-1], old)))
    elif a.command in ("score", "explain"):
        from .model import attribution, manifest, train
        from .schemas import contract
        from .sources.publish import scratch, write_parquet

        model, m = manifest.open_model(spark, a.model)
        features, table = contract(m["contract"]), train.labelled(spark, a.tables, m["contract"])
        if a.command == "score":
            write_parquet(train.score(model, table, features, ["event_id", "event_us", "split"]), a.target)
        else:
            found = attribution.contributions(model, table.where("split = 'test'"), features, [], scratch(spark))
            attribution.importance(found, features).orderBy("mean_abs", ascending=False).show(100, truncate=False)
    else:
        from .model.train import fit_and_evaluate
        from .operators.evaluate import BETTER, deltas

        base, new = (fit_and_evaluate(spark, a.tables, v, a.learner) for v in (17, max(25, a.contract)))
        deltas(base, new, ["split"], list(BETTER)).show(truncate=False)


if __name__ == "__main__":
    main()
