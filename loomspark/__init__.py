"""loomspark: a PySpark-native retrieval and document-analytics engine."""

VERSION = "0.1"
