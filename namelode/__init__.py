"""Watch-list screening and entity resolution on Spark DataFrames."""
