"""prismara: a PySpark-native analytics engine for semantic media indexes."""

__version__ = "0.1.0"
