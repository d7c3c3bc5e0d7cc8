"""A Spark-native engine for event evidence: timelines, labels, pooling, folds, models."""
