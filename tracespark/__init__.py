"""Spark-first analytics over motion-trace data: declarative plans, Arrow kernels only where SQL cannot follow."""
