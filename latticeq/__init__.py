"""Spark-native operators for fragment- and sequence-shaped data."""
