"""Road-condition analytics and corpus operators on Spark DataFrames."""
