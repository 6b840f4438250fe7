"""Dataset-quality, evaluation and experiment analytics as Spark DataFrame operators."""
