"""tidewatch: a Spark-native engine for tracking what changed in a stream of text signals."""
