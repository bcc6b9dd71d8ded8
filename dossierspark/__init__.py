"""Evidence tables on Spark: every operator is a function from DataFrame to DataFrame."""
