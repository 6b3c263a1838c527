"""stratalog: log and PartiQL analytics compiled to Spark DataFrames."""
