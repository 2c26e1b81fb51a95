"""pathlight: graph centrality and corpus preparation as Spark DataFrame jobs."""
