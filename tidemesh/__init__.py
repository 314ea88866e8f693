"""tidemesh: mesh telemetry analytics on PySpark DataFrames."""
