"""corpusloom: Spark-native analytics over labelled message corpora."""
