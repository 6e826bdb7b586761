"""splitproof: a Spark-native engine that audits labelled datasets and their evaluations."""
