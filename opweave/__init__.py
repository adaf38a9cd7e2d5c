"""opweave: Spark-first analytics over operation logs, work segments and the records around them."""
