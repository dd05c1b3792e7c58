"""Evidence analytics over citable text corpora, on Spark DataFrames."""
