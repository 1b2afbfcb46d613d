"""Column expressions: every helper takes and returns Spark columns."""
