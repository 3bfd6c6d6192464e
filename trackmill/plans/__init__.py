"""Named queries over the driver's tables."""

from . import streams, studies, tracks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
