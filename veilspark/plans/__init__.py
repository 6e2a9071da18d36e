"""Registered queries over the given tables."""

from . import datasets, detection, gates, geometry, metrics, redaction, streams, surface
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "datasets", "detection", "gates", "geometry", "metrics", "redaction", "streams", "surface"]
