"""docmill: Spark-native enrichment of document tables."""
