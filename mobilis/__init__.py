"""Evidence-to-decision analytics on Spark DataFrames."""
