"""memlake: text memories, a typed property graph and hybrid retrieval as lazy PySpark plans."""
