"""Spark-native spatial and urban analytics: every operator is DataFrame in, DataFrame out."""
