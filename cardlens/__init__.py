"""cardlens: cardinality statistics, bounds and correction on Spark SQL."""
