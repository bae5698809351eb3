"""millrace: hybrid retrieval, log folding and data-pipeline operators as Spark DataFrame plans."""
