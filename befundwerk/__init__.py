"""Spark-native toolkit for report corpora that are checked against structured tables."""
