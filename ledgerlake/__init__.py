"""ledgerlake: a file-catalog integrity engine on Spark DataFrames."""
