"""Access-log analytics on PySpark: sources, features, rules, models and reports."""
