"""Topic and table pipelines expressed as Spark DataFrames."""
