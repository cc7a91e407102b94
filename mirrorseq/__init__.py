"""Spark-native scoring of generated multivariate sequences against ground truth."""
