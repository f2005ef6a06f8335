"""quarrytext: trigram text search and indexing over Spark DataFrames."""
