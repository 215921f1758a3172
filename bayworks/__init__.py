"""Spark-native analytics for a vehicle-service network."""

from bayworks.config import Config
from bayworks.session import configure

__all__ = ["Config", "configure"]
