"""A batch analytics engine on PySpark: relational operators, SQL plans, sources and sinks."""
