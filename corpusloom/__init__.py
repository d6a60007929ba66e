"""Text-corpus operators for PySpark: DataFrame in, DataFrame out."""
