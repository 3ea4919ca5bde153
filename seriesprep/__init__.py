"""Spark-native preparation and evaluation of labelled sensor time series."""

from seriesprep.schema import SeriesLayout

__all__ = ["SeriesLayout"]
