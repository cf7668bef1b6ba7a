"""Transaction-risk analytics on PySpark DataFrames, pyspark.ml and Structured Streaming."""
