"""The SQL dialect: tokens, translation to Spark SQL, statements."""
