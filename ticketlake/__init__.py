"""Help-desk analytics as Spark DataFrame operators."""
