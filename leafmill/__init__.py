"""leafmill: a Spark-first engine for searching and enriching document collections."""

__version__ = "0.1.0"
