"""quern: a PySpark-native analytics engine for machine-learning-oriented data work."""
