"""Pandas UDFs whose type is parsed on first use, when a session exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``F.pandas_udf(returns)``, but a module may use it before there is a session."""

    def decorate(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*cols: Column | str) -> Column:
            return F.pandas_udf(fn, returns)(*cols)

        call.plain = fn
        return call

    return decorate
