"""corpusloom: permission-aware retrieval, quality analytics and corpus preparation on PySpark."""
