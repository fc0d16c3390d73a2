"""Spark-first analytics over typed property graphs and the text attached to them."""
