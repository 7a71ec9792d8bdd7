"""querent: a Spark-native engine for evaluating question answering over documents."""

__version__ = "0.1.0"
