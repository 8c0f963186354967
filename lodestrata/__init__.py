"""lodestrata: a PySpark-native engine for evidence-grounded text retrieval and data processing."""

__version__ = "0.1.0"
