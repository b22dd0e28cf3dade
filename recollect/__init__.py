"""Spark-native analytics over associative memory data: recall, spreading activation, decay, consolidation and completion."""
