"""Columns that are built once for each application, as building a large expression takes seconds of the driver."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession

_MADE: dict[tuple, list[Column]] = {}


def once(build):
    """A function without arguments that gives a list of columns; they are made by the first call of an application."""

    @functools.wraps(build)
    def made() -> list[Column]:
        key = (SparkSession.active().sparkContext.applicationId, build.__module__, build.__name__)
        if key not in _MADE:
            _MADE[key] = build()
        return _MADE[key]

    return made
