"""Scores how ready a large estate of tables is for analytical and machine use, on Spark."""

from tablegauge.params import ALL_DATABASES, ScanParams

__all__ = ["ALL_DATABASES", "ScanParams"]
