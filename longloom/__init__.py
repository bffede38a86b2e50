"""Tall measurement tables to model-ready feature matrices, as Spark jobs."""
