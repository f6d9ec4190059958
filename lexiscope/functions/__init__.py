"""Column -> Column expressions. Everything here is a built-in Spark SQL
expression, so it runs inside whole-stage codegen; no Python UDF."""
