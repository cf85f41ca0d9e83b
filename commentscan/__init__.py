"""Find and moderate harmful comments at scale with Spark DataFrames."""
