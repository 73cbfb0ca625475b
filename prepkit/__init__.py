"""prepkit: data profiling, quality assessment and preparation on Spark DataFrames."""
