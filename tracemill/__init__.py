"""tracemill: a PySpark-native analytics engine for agent session logs and reasoning trajectories."""

__version__ = "0.1.0"
