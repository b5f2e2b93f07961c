"""Spark-native event coding: stories in, structured political events out."""
