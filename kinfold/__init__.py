"""kinfold: find, group and curate similar records with PySpark DataFrames."""
