"""kindred: fuzzy string matching and near-duplicate name detection on Spark DataFrames."""
