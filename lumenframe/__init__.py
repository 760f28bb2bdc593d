"""Spark-native analytics for structure-from-motion data and training-corpus preparation."""
