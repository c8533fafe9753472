"""reelquery: a Spark-native engine for curating frame-level detection data."""
