"""tidemark: quantitative research and corpus analytics as Spark DataFrame jobs."""
