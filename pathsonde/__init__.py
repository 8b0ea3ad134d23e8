"""Spark-native search and analytics over file metadata."""
