"""Stream throughput analytics on Spark."""

from tidegauge.session import build_session

__all__ = ["build_session"]
