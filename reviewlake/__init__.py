"""reviewlake: a PySpark-native engine for auditable literature-review data."""

__version__ = "0.1.0"
