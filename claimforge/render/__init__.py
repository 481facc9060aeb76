"""Reports: their lines are made by Spark, one text per patent or theme, and written by its sinks."""
