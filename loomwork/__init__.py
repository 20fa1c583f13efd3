"""loomwork: a Spark-native data unification and entity search engine."""
