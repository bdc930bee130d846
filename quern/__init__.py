"""quern: a text-analytics and retrieval engine built on Spark DataFrames."""
