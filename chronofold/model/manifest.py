"""Manifest of a trained model: what it was made from, how it was judged, and whether it may be promoted."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from ..operators.evaluate import BETTER
from ..schemas import contract
from ..sources.publish import Files, to_json

VERSION = 1
FIELDS = {"version", "name", "status", "contract", "features", "target", "source", "catalog", "splits", "learner", "rows", "metrics", "promoted"}
STATUSES = ("candidate", "promoted")
#: What is predicted.
TARGET = {"column": "rating", "at_least": 4.0}
#: What each metric may lose against the model in place before promotion is refused.
TOLERANCE = 1e-4


def build(name: str, contract_version: int, source: str, catalog: str, splits: list, metrics: dict[str, dict], against: dict[str, dict] | None = None, learner: dict | None = None, rows: dict[str, int] | None = None) -> dict:
    """``metrics`` and ``against``: by split, the metrics of this model and of the one in place; ``rows``: by split, how many
    there were; ``learner``: its kind and parameters. A model that falls behind stays a candidate."""
    good = better(metrics.get("test"), (against or {}).get("test"))
    m = {
        "version": VERSION, "name": name, "status": STATUSES[good], "contract": contract_version, "features": _columns(contract_version), "target": TARGET,
        "source": source, "catalog": catalog, "splits": [list(s) for s in splits], "learner": learner or {}, "rows": rows or {}, "metrics": metrics, "promoted": good,
    }
    check(m)
    return m


def _columns(version: int) -> list[dict]:
    """The contract's features: name, kind, whether they may be missing, role; in order."""
    return [{"name": f.name, "kind": f.kind, "nullable": f.nullable, "role": f.role} for f in contract(version)]


def better(new: dict | None, old: dict | None) -> bool:
    """Whether no metric of the test split falls behind; without one in place, whether there are metrics."""
    if not new:
        return False
    return all(BETTER[k] * (new[k] - old[k]) >= -TOLERANCE for k in BETTER) if old else True


def check(m: dict) -> None:
    if set(m) != FIELDS:
        raise ValueError(f"fields differ: {sorted(set(m) ^ FIELDS)}")
    if m["version"] != VERSION:
        raise ValueError(f"version {m['version']}")
    if m["features"] != _columns(m["contract"]):
        raise ValueError("features differ from the contract's")
    if m["target"] != TARGET:
        raise ValueError("the target differs")
    if m["status"] != STATUSES[bool(m["promoted"])]:
        raise ValueError(f"status {m['status']} of a model that is{'' if m['promoted'] else ' not'} promoted")
    if m["rows"] and set(m["rows"]) != set(m["metrics"]):
        raise ValueError("rows and metrics are of different splits")
    for k in ("source", "catalog"):
        if not re.fullmatch(r"[0-9a-f]{64}", str(m[k])):
            raise ValueError(f"{k} is no digest")
    for split, values in m["metrics"].items():
        for k in BETTER:
            v = values.get(k)
            if v is None or v != v or not 0 <= v <= (1 if k != "log_loss" else float("inf")):
                raise ValueError(f"{split}: {k} is {v}")


def validate(spark: SparkSession, m: dict, sf_dir: str, artifact: str | None = None) -> None:
    """Holds a manifest against the tables that it names by digest, the splits in force, and, with ``artifact``, the sidecar
    of a materialised feature table; raises ValueError."""
    from .. import views
    from ..catalogue.entities import SPLITS
    from ..state.checkpoints import catalog_id, source_id

    check(m)
    if m["splits"] != [list(s) for s in SPLITS]:
        raise ValueError("the splits differ")
    if m["source"] != source_id(views.events(spark, sf_dir)):
        raise ValueError("the model comes from other events")
    if m["catalog"] != catalog_id(views.catalog(spark, sf_dir)):
        raise ValueError("the model comes from another catalogue")
    if artifact is not None:
        side = json.loads(Files(spark, artifact).read(f"{artifact}.json"))
        for k in ("contract", "source", "catalog"):
            if side[k] != m[k]:
                raise ValueError(f"the artifact's {k} differs")


def publish_model(spark: SparkSession, sf_dir: str, path: str, version: int = 17, kind: str = "gbt", name: str = "model", against: dict | None = None) -> dict:
    """Fits, evaluates and saves a model under ``path``, which must not exist, with its manifest beside it in ``path.json``.

    ``against`` is the manifest of the model in place. The manifest comes last, so a model without one is no model.
    """
    from .. import views
    from ..catalogue.entities import SPLITS
    from ..state.checkpoints import catalog_id, source_id
    from .train import evaluate_splits, fit, fit_trees, labelled, score

    if Files(spark, path).exists(path):
        raise FileExistsError(path)
    table, features = labelled(spark, sf_dir, version), contract(version)
    model = fit_trees(table, features) if kind == "gbt" else fit(table.where("split = 'train'"), features, kind)
    found = {r["split"]: r for r in evaluate_splits(score(model, table, features, ["split", "y"])).collect() if r["split"]}
    metrics = {s: {k: r[k] for k in BETTER} for s, r in found.items()}
    last = model.stages[-1]
    learner = {"kind": kind, "parameters": {p.name: last.getOrDefault(p) for p in last.params if last.isDefined(p) and isinstance(last.getOrDefault(p), int | float | str)}}
    if kind == "gbt":
        learner["trees"] = last.getNumTrees
    rows, was = {s: r["n"] for s, r in found.items()}, (against or {}).get("metrics")
    m = build(name, version, source_id(views.events(spark, sf_dir)), catalog_id(views.catalog(spark, sf_dir)), SPLITS, metrics, was, learner, rows)
    model.save(path)
    write(spark, m, f"{path}.json")
    return m


def open_model(spark: SparkSession, path: str):
    """A saved model and its manifest, which is checked."""
    from pyspark.ml import PipelineModel

    m = read(spark, f"{path}.json")
    return PipelineModel.load(path), m


def dumps(m: dict) -> str:
    check(m)
    return to_json(m)


def write(spark: SparkSession, m: dict, path: str, force: bool = False) -> None:
    """Writes a manifest; another one in its place is kept unless ``force``."""
    files, text = Files(spark, path), dumps(m)
    if files.exists(path) and not force and files.read(path) != text:
        raise FileExistsError(path)
    files.write(path, text)


def read(spark: SparkSession, path: str) -> dict:
    m = json.loads(Files(spark, path).read(path))
    check(m)
    return m
