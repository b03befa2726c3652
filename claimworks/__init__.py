"""Grounded-claim analytics as Spark DataFrame plans."""
