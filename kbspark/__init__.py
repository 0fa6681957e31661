"""kbspark: Spark jobs that build and query a knowledge base at scale."""
