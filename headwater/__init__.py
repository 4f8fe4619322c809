"""headwater: lineage and change-impact analysis expressed as Spark DataFrames."""
