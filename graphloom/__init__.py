"""graphloom: Spark-native preparation and scoring of question-to-graph-query data."""
