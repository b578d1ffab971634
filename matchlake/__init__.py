"""Competitive-match analytics as Spark DataFrame operators."""
