"""Column-only functions: no UDF, so they stay within whole-stage code generation where Spark allows."""
