"""Multi-modal table curation and embedding analytics on Spark DataFrames."""
