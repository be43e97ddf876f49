"""playlake: listening-history analytics on Spark DataFrames."""
