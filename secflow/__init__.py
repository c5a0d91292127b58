"""secflow: security-event analytics as PySpark DataFrame operators."""
