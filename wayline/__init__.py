"""wayline: a PySpark-native engine for vehicle and phone sensor time series."""

__version__ = "0.1.0"
