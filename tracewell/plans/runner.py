"""Stages with content-addressed results, experiment grids and run statistics."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A named step; f takes (session, inputs, settings)."""

    name: str
    f: Callable[..., DataFrame]
    settings: dict = field(default_factory=dict)
    after: tuple[str, ...] = ()


def stage_key(stage: Stage, above: dict[str, str]) -> str:
    """Hash of a stage's settings and of the keys of the stages it reads."""
    said = json.dumps([stage.name, stage.settings, [above[a] for a in stage.after]], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def run_stages(spark: SparkSession, stages: list[Stage], root: str, restart: frozenset[str] = frozenset(), took: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Results by name; a stage that is done under its key is read, unless it or one above it restarts. took gets seconds by stage."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    keys: dict[str, str] = {}
    out: dict[str, DataFrame] = {}
    redone: set[str] = set()
    for s in stages:
        keys[s.name] = stage_key(s, keys)
        path = f"{root}/{s.name}/{keys[s.name]}"
        began = time.monotonic()
        again = s.name in restart or any(a in redone for a in s.after)
        done = fs(f"{path}/_SUCCESS")
        if again or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            s.f(spark, {a: out[a] for a in s.after}, s.settings).write.mode("overwrite").parquet(path)
            if again:
                redone.add(s.name)
        out[s.name] = spark.read.parquet(path)
        if took is not None:
            took[s.name] = time.monotonic() - began
    return out


def merged(*layers: dict) -> dict:
    """Nested settings; later layers win."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_dotted(settings: dict, changes: dict[str, object]) -> dict:
    """Settings with values at dotted keys replaced; unknown keys are an error."""
    out = merged(settings)
    for key, value in changes.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at[p]
        if last not in at:
            raise ValueError(f"no setting {key}")
        at[last] = value
    return out


def load(path: str, known: dict | None = None) -> dict:
    """Settings of a YAML file over those it names in `include` (a path beside it); checked against known."""
    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    above = own.pop("include", None)
    out = merged(load(os.path.join(os.path.dirname(path), above)), own) if above else own
    if known is not None:
        check_types(out, known)
    return out


@dataclass(frozen=True)
class Setting:
    """What a setting may be: a type, and allowed values (a text may list several, by commas)."""

    type: type
    values: tuple[str, ...] | None = None


def check_types(settings: dict, known: dict, path: str = "") -> None:
    """Unknown names, missing values, wrong types and values that are not allowed are errors."""
    for key, value in settings.items():
        at = f"{path}{key}"
        if key not in known:
            raise ValueError(f"no setting {at}")
        want = known[key]
        if isinstance(want, dict):
            if not isinstance(value, dict) or not value:
                raise ValueError(f"{at} is empty")
            check_types(value, want, f"{at}.")
        elif value is None:
            raise ValueError(f"{at} has no value")
        elif not isinstance(value, want.type) or isinstance(value, bool) and want.type is not bool:
            raise TypeError(f"{at} should be {want.type.__name__}")
        elif want.values is not None and (bad := [v for v in map(str.strip, str(value).split(",")) if v not in want.values]):
            raise ValueError(f"{at} may not be {bad[0]}")


def leaves(known: dict, path: str = "") -> dict[str, Setting]:
    """Settings by dotted name."""
    out: dict[str, Setting] = {}
    for key, value in known.items():
        out |= leaves(value, f"{path}{key}.") if isinstance(value, dict) else {f"{path}{key}": value}
    return out


def from_command_line(settings: dict, known: dict, arguments: list[str]) -> dict:
    """Settings with those changed that the arguments name, each `--dotted.name value`."""
    import argparse

    parser = argparse.ArgumentParser()
    read = lambda t: (lambda s: s.lower() in ("1", "true", "yes")) if t is bool else t
    for name, s in leaves(known).items():
        parser.add_argument(f"--{name}", type=read(s.type))
    out = merged(settings)
    for name, value in vars(parser.parse_args(arguments)).items():
        if value is not None:
            *path, last = name.split(".")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    check_types(out, known)
    return out


def grid(values: dict[str, list]) -> list[dict]:
    """All combinations, in order of the given lists."""
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


def resolved(settings: dict) -> dict:
    """Settings with sizes in place of numbers that stand for them: -1 is the hidden size, for the output size -2 half of it."""
    hidden = settings.get("node_hid_dim")
    out = dict(settings)
    for name in ("node_out_dim", "tgn_memory_dim", "tgn_time_dim"):
        if hidden is not None and out.get(name) == -1:
            out[name] = hidden
    if hidden is not None and out.get("node_out_dim") == -2:
        out["node_out_dim"] = hidden // 2
    return out


def check_combination(settings: dict) -> None:
    """Combinations that cannot work."""
    get = settings.get
    objective, decoder = get("objective", ""), get("decoder", "")
    wrong = [
        ("an edge objective needs an edge decoder", objective.startswith("predict_edge") and decoder.startswith("node")),
        ("a node objective needs a node decoder", objective.startswith("predict_node") and decoder.startswith("edge")),
        ("temporal memory does not go with stacked graphs", get("tgn") and get("batching") == "inter_graph"),
        ("temporal memory needs last neighbours, and they need it", "last_neighbours" in settings and bool(get("tgn")) != bool(get("last_neighbours"))),
        ("last neighbours need times, which pseudo graphs lack", get("last_neighbours") and get("transform") == "pseudo_graph"),
        ("pseudo graphs have no edge types to predict", get("transform") == "pseudo_graph" and objective == "predict_edge_type"),
        ("pretrained vectors have 300 dimensions", get("features") == "fasttext" and get("pretrained") and get("size") != 300),
        ("masked objectives go with the magic threshold", objective in ("reconstruct_masked", "predict_masked_struct") and get("threshold") != "magic"),
        ("few-shot training needs a generated attack", get("few_shot") and not str(get("transform", "")).startswith("synthetic_attack")),
        ("these features are for one dataset", get("multi_dataset") and get("features") not in (None, "word2vec", "fasttext", "hierarchical_hashing", "only_type")),
        ("edges are not evaluated where nodes are scored", get("evaluation") == "edge" and get("level") == "node"),
    ]
    for what, is_so in wrong:
        if is_so:
            raise ValueError(what)


def varied(settings: dict, name: str, delta: float, steps: int) -> list[dict]:
    """Settings with a number spread evenly over plus and minus a share of itself, whole numbers kept whole."""
    middle = settings[name]
    shares = [0.0] if steps == 1 else [delta * (2 * i / (steps - 1) - 1) for i in range(steps)]
    return [merged(settings, {name: type(middle)(round(middle * (1 + s)) if isinstance(middle, int) else middle * (1 + s))}) for s in shares]


def ensemble(settings: dict, n: int) -> list[dict]:
    """Settings of n runs that differ in their seed."""
    return [merged(settings, {"seed": settings.get("seed", 0) + i}) for i in range(n)]


def best_run(runs: DataFrame) -> DataFrame:
    """The run of greatest adp, then discrimination; ties take the least name."""
    return runs.orderBy(F.desc("adp"), F.desc("discrim"), "run").limit(1)


def extremes(runs: DataFrame, metric: str) -> DataFrame:
    """The rows of least and of greatest metric, as which = least, greatest."""
    row = F.struct(*runs.columns)
    ends = runs.agg(F.min_by(row, metric).alias("l"), F.max_by(row, metric).alias("g"))
    return ends.select(F.lit("least").alias("which"), "l.*").unionByName(ends.select(F.lit("greatest").alias("which"), "g.*"))


def run_statistics(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, rel_std, least, greatest) over runs."""
    rows = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("r")).select("r.*")
    std, mean = F.stddev_pop("v"), F.avg("v")
    return rows.groupBy("metric").agg(mean.alias("mean"), std.alias("std"), F.when(mean != 0, std / mean * 100).alias("rel_std"), F.min("v").alias("least"), F.max("v").alias("greatest"))


# Named systems, as features, encoder, objective and threshold. Two families go by what they do.
PRESETS = {
    "linear_edge_type": {"features": "word2vec", "encoder": "linear", "objective": "predict_edge_type", "threshold": "max_val_loss"},
    "temporal_edge_type": {"features": "word2vec", "size": 128, "encoder": "tgn_attention", "objective": "predict_edge_type", "threshold": "max_val_loss", "kmeans": 30},
    "temporal_edge_type_unseen": {"features": "word2vec", "size": 128, "trained_on": "train", "encoder": "tgn_attention", "objective": "predict_edge_type", "threshold": "max_val_loss"},
    "temporal_edge_type_fixed": {"features": "only_type", "encoder": "tgn_attention", "objective": "predict_edge_type", "threshold": "max_val_loss", "evaluation": "edge"},
    "kairos": {"features": "hierarchical_hashing", "size": 16, "encoder": "tgn_attention", "objective": "predict_edge_type", "threshold": "max_val_loss", "queue": 20},
    "flash": {"features": "flash", "size": 30, "encoder": "sage", "objective": "predict_node_type", "threshold": "flash"},
    "magic": {"features": "only_type", "encoder": "gat", "objective": "reconstruct_masked", "threshold": "magic"},
    "nodlink": {"features": "fasttext", "size": 256, "transform": "undirected", "encoder": "sum", "objective": "reconstruct_node_feat", "threshold": "nodlink"},
    "threatrace": {"features": "edges_distribution", "encoder": "sage", "objective": "predict_node_type", "threshold": "threatrace"},
    "rcaid": {"features": "doc2vec", "transform": "pseudo_graph", "encoder": "gat", "objective": "predict_node_type", "threshold": "max_val_loss"},
}
