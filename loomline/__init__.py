"""loomline: SQL-script lineage and data-model reconciliation on Spark DataFrames."""
