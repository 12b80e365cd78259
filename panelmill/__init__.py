"""Panel analytics on Spark: declarative DataFrame plans for entity x month data."""
