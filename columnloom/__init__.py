"""Column alignment across independent data sources, as Spark plans."""
