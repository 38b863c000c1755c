"""Evidence-cohort analytics as lazy Spark DataFrame operators."""
