"""siltstone: Spark-native curation, detection and evaluation of code and text corpora."""
