"""ledgerloom: risk analytics on DataFrames, Spark SQL and Structured Streaming."""
