"""auralake: a Spark-native fingerprint, similarity and catalogue analytics engine."""
