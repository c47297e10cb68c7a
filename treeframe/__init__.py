"""treeframe: hierarchical, file-like data as Spark DataFrames."""
