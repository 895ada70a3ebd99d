"""docloom: document-IR analytics and training-data operators as Spark jobs."""
