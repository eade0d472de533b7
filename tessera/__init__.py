"""Document retrieval, incremental corpus building and declarative record rules on PySpark."""
