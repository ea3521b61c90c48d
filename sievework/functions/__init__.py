"""Text kernels without Spark, their Arrow functions, and native column expressions."""
