"""Spark-native audit and keyword analytics over stored web-crawl snapshots."""
