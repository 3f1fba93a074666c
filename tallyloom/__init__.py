"""tallyloom: expected-cost analytics and operational data operators on PySpark."""

__version__ = "0.1.0"
