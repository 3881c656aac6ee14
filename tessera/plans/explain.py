"""What a query will do: the stages after rewriting, and the engine's physical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.find import aggregate, find
from tessera.plans.stages import parse_pipeline, rewrite


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _about(df: DataFrame) -> dict[str, object]:
    text = physical(df)
    return {
        "pushed": [line.split("PushedFilters: ")[1].split("], ")[0] + "]" for line in text.splitlines() if "PushedFilters: [" in line],
        "read": [line.split("ReadSchema: ")[1] for line in text.splitlines() if "ReadSchema: " in line],
        "shuffles": text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning") + text.count("Exchange SinglePartition"),
        "topk": text.count("TakeOrderedAndProject"),
        "python": any(x in text for x in ("ArrowEvalPython", "MapInArrow", "BatchEvalPython")),
        "plan": text,
    }


def explain_pipeline(df: DataFrame, pipeline: object, hint: object = None) -> dict[str, object]:
    """``stages`` as they will run, ``hint`` as given, and what the plan pushes, reads and shuffles."""
    return {"stages": [s.kind for s in rewrite(parse_pipeline(pipeline))], "hint": hint} | _about(aggregate(df, pipeline))


def explain_find(df: DataFrame, filter: object = None, sort: object = None, skip: int = 0, limit: int = 0, projection: object = None, hint: object = None) -> dict[str, object]:
    steps = ["match"] + ["sort"] * bool(sort) + ["skip"] * bool(skip) + ["limit"] * bool(limit) + ["project"] * bool(projection)
    return {"stages": steps, "hint": hint} | _about(find(df, filter, sort, skip, limit, projection))
