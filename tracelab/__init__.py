"""Spark-native analysis of sensor traces together with sparse, dated scores."""
