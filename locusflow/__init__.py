"""locusflow: bulk-segregant analytics on Spark DataFrames."""
