"""cadenza: a Spark-native engine for measurement tables, evaluation statistics and training-data preparation."""
