"""entiforge: a PySpark-native engine for entity resolution and name disambiguation."""

__version__ = "0.1.0"
