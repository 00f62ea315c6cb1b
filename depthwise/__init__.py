"""Sequencing-coverage analytics on Spark DataFrames."""
