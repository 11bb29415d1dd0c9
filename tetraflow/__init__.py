"""A PySpark engine for partitioned tetrahedral meshes held as DataFrames."""
