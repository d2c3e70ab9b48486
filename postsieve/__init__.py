"""Mail-style text classification data, prepared, learned from and scored in Spark."""

__version__ = "0.3.0"
