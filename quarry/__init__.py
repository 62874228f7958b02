"""quarry: Spark-native queries over text and source-code corpora."""
