"""quern: Spark-native retrieval and data processing over source-code and document corpora."""

__version__ = "0.1.0"
