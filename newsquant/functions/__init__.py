"""Column-in, column-out helpers built only from Spark SQL functions."""
