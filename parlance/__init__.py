"""Chat-archive analytics as Spark DataFrame operators."""

from parlance.model import Profile

__all__ = ["Profile"]
