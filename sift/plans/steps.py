"""M8 + D2: a configurable list of DataFrame steps with checked parameters.

Each step is ``(name, function, params)``; ``function(df, **params)`` returns a
DataFrame.  Unknown parameter names are rejected (the original silently
ignored them, so some grid keys had no effect).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame


def check_params(fn: Callable, params: dict) -> None:
    sig = inspect.signature(fn)
    allowed = [p for p in list(sig.parameters)[1:]]
    unknown = sorted(set(params) - set(allowed))
    if unknown:
        raise ValueError(f"{fn.__name__}: unknown parameters {unknown}; allowed {allowed}")


def run_steps(df: DataFrame, steps: list[tuple[str, Callable, dict]]) -> DataFrame:
    for _, fn, params in steps:
        check_params(fn, params)
        df = df.transform(lambda d, f=fn, p=params: f(d, **p))
    return df
