"""Spark-native analytics over tool outputs, agent trajectories and text corpora."""
