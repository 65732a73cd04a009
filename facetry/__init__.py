"""Multi-modal entity analytics and corpus preparation on Spark DataFrames."""
