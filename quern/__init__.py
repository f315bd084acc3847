"""quern: relational evaluation analytics as PySpark DataFrame plans."""
