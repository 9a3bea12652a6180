"""veingraph: triple-graph analytics and corpus preparation on PySpark DataFrames."""
