"""lokalis: a PySpark-native engine for collecting, placing, matching and exporting venue records."""

__version__ = "0.1.0"
