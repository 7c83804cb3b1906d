"""A document privacy engine on Spark."""
