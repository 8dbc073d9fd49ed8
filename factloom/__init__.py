"""Web-content, market-data and metering analytics expressed as PySpark jobs."""

__version__ = "0.1.0"
