"""filmcrate: a media-catalog analytics engine expressed in PySpark DataFrames."""
