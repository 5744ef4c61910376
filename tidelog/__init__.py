"""Search and analytics over machine-generated events, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
