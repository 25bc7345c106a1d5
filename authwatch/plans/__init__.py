"""Pipeline stages; every stage maps DataFrames to DataFrames."""
