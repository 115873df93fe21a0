"""weftwork: a Spark-first engine for searching, linking and checking text and object metadata."""
