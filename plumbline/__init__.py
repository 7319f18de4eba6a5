"""plumbline: data-consistency screening and corpus preparation on PySpark."""
