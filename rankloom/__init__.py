"""rankloom: PySpark-native processing of recommender and scholarly-paper data."""

__version__ = "0.1.0"
