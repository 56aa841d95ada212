"""seqframe: sequence analytics on Spark DataFrames."""
