"""loomark: bulk web-document analytics on Spark DataFrames."""
