"""Lodestone: a Spark-first relational analytics engine."""
