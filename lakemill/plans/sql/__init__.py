"""The SQL dialect's front end: tokens, and a translator from the dialect to Spark SQL."""
