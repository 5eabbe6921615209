"""Query catalogue: name -> Spark callable and DuckDB statement."""
