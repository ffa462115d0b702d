"""Spark-native analytics over the records that media tools emit."""
