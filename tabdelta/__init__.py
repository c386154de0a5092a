"""tabdelta: compare, check and merge versions of tabular data as Spark DataFrame jobs."""
