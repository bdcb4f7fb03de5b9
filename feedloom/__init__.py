"""Spark-native queries for a news-and-community platform. Every query is a function of DataFrames to a DataFrame."""
