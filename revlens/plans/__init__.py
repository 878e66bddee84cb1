"""Jobs made of operators, the registry of queries and their SQL twins."""
