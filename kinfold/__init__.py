"""kinfold: golden-record analytics on Spark DataFrames."""
