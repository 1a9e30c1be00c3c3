"""Card-transaction analytics and recommendations on Spark DataFrames."""
