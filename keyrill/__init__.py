"""keyrill: analytics over hash-keyed put logs, written for Spark DataFrames."""
