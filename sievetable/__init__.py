"""Open-data quality, reshaping and bounded-query operators for Spark."""

from sievetable.session import build_session

__all__ = ["build_session"]
