"""Case intelligence on Spark: article intake, case tables, text reports."""
