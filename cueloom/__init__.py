"""cueloom: Spark-native analytics over timed text, events and corpora."""

__version__ = "0.1.0"
