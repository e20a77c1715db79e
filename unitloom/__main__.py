"""python -m unitloom STAGE --option value ...: run a stage; its result, if it is a table, is printed."""

from __future__ import annotations

import argparse
import dataclasses
import inspect
import types
import typing

from pyspark.sql import DataFrame, SparkSession

from unitloom import stages
from unitloom.ship import prepare

STAGES = {
    "models": stages.fit_models, "graph": stages.train_graph, "kmeans": stages.train_kmeans, "infer": stages.infer_labels, "evaluate": stages.evaluate, "boundaries": stages.evaluate_boundaries,
    "sweep": stages.sweep, "chain": stages.chain, "report": stages.report, "zipf": stages.zipf, "examples": stages.examples,
}


def _options(function) -> dict[str, tuple[type, object]]:
    """Dotted option names with their type and default (`inspect._empty` where one must be given)."""
    hints = typing.get_type_hints(function)
    found = {}

    def walk(prefix: str, kind: type) -> None:
        inner = typing.get_type_hints(kind)
        for f in dataclasses.fields(kind):
            t = _plain(inner[f.name])
            if dataclasses.is_dataclass(t):
                walk(f"{prefix}{f.name}.", t)
            else:
                found[prefix + f.name] = (t, inspect._empty if f.default is dataclasses.MISSING else f.default)

    for p in list(inspect.signature(function).parameters.values())[1:]:
        t = _plain(hints[p.name])
        if dataclasses.is_dataclass(t):
            walk("", t)
        else:
            found[p.name] = (t, p.default)
    return found


def _plain(t):
    return next(x for x in typing.get_args(t) if x is not type(None)) if isinstance(t, types.UnionType) else t


def _built(kind: type, values: dict[str, object], prefix: str = ""):
    hints = typing.get_type_hints(kind)
    made = {}
    for f in dataclasses.fields(kind):
        t = _plain(hints[f.name])
        if dataclasses.is_dataclass(t):
            made[f.name] = _built(t, values, f"{prefix}{f.name}.")
        elif prefix + f.name in values:
            made[f.name] = values[prefix + f.name]
    return kind(**made)


def parse(argv: list[str] | None = None) -> tuple[str, dict[str, object]]:
    parser = argparse.ArgumentParser(prog="unitloom", description=__doc__)
    chosen = parser.add_subparsers(dest="stage", required=True)
    for name, function in STAGES.items():
        sub = chosen.add_parser(name, help=function.__doc__)
        for option, (kind, default) in _options(function).items():
            extra = {"action": argparse.BooleanOptionalAction} if kind is bool else {"type": kind}
            sub.add_argument(f"--{option}", dest=option, required=default is inspect._empty, default=argparse.SUPPRESS, **extra)
    values = vars(parser.parse_args(argv))
    return values.pop("stage"), values


def call(spark: SparkSession, stage: str, values: dict[str, object]):
    function = STAGES[stage]
    hints = typing.get_type_hints(function)
    last = list(inspect.signature(function).parameters)[1]
    if dataclasses.is_dataclass(hints[last]):
        return function(spark, _built(hints[last], values))
    return function(spark, **values)


def main() -> None:
    stage, values = parse()
    spark = SparkSession.builder.appName(f"unitloom {stage}").getOrCreate()
    prepare(spark)
    found = call(spark, stage, values)
    if isinstance(found, DataFrame):
        found.show(100, truncate=False)
    else:
        print(found)


if __name__ == "__main__":
    main()
