"""factflow: program facts, fixpoints and lineage as Spark DataFrames."""
