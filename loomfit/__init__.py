"""Spark-native training of co-occurrence embeddings and logistic factorization."""
