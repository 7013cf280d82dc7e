"""Param helpers: JSON frames, dates, metadata."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame


def with_meta(df: DataFrame, column: str, meta: dict) -> DataFrame:
    return df.withMetadata(column, meta)


class Converters(TypeConverters):
    @staticmethod
    def to_frame(value) -> pd.DataFrame:
        """A pandas frame from itself or from its JSON text."""
        if isinstance(value, pd.DataFrame):
            return value
        if isinstance(value, str):
            return pd.DataFrame(json.loads(value))
        raise TypeError(f"no frame: {type(value).__name__}")

    @staticmethod
    def to_date(value) -> dt.datetime:
        """A datetime from itself, a date, an ISO text, or a list or tuple of its parts."""
        if isinstance(value, dt.datetime):
            return value
        if isinstance(value, dt.date):
            return dt.datetime(value.year, value.month, value.day)
        if isinstance(value, str):
            return dt.datetime.fromisoformat(value)
        if isinstance(value, (list, tuple)):
            return dt.datetime(*value)
        raise TypeError(f"no date: {type(value).__name__}")


class FrameParamsWriter(DefaultParamsWriter):
    """Writes frames as JSON and dates as text."""

    def saveImpl(self, path: str) -> None:
        plain = {}
        for p, v in self.instance.extractParamMap().items():
            plain[p.name] = v.to_json() if isinstance(v, pd.DataFrame) else v.isoformat() if isinstance(v, dt.datetime) else v
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, paramMap=plain)


class FrameParamsWritable(DefaultParamsWritable):
    def write(self) -> FrameParamsWriter:
        return FrameParamsWriter(self)


class HasDates(Params, FrameParamsWritable, DefaultParamsReadable):
    """Mixin: start and end date."""

    start_date = Param(Params._dummy(), "start_date", "first date", Converters.to_date)
    end_date = Param(Params._dummy(), "end_date", "last date", Converters.to_date)

    def setDates(self, start, end) -> "HasDates":
        return self._set(start_date=start, end_date=end)

    def getStartDate(self) -> dt.datetime:
        return self.getOrDefault("start_date")

    def getEndDate(self) -> dt.datetime:
        return self.getOrDefault("end_date")
