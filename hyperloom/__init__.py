"""Analytics over directed interaction networks and membership hypergraphs, on Spark DataFrames."""
