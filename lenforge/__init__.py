"""lenforge: length-aware preparation and batching of instruction corpora on Spark."""

__version__ = "0.1.0"
