"""flockline: co-movement queries over tracked objects, as Spark plans."""
