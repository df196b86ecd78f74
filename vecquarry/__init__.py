"""vecquarry: a PySpark-native engine for nearest-neighbour analytics over embedding tables."""

__version__ = "0.1.0"
