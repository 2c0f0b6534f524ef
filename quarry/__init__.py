"""quarry: document retrieval, incremental indexing and catalogue queries on Spark DataFrames."""
