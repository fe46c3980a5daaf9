"""Sending this package to Python workers that don't run in its folder."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose first argument is the session, with this package sent to the workers before its first call in an application."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **named) -> DataFrame:
        sc = spark.sparkContext
        if sc.applicationId not in _SENT:
            here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "readloom"), "zip", here, "readloom"))
            _SENT.add(sc.applicationId)
        return f(spark, *args, **named)

    return run
