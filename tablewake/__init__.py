"""Table lineage over SQL scripts and database client logs, as Spark DataFrames."""
