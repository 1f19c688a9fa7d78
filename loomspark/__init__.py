"""loomspark: hybrid retrieval, knowledge-graph analytics and corpus preparation on Spark DataFrames."""
