"""tessera: a Spark-first knowledge-graph and retrieval engine over tables, code and text."""

__version__ = "0.1.0"
