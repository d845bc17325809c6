"""contactrank: contact ingest, ranked search and corpus preparation as Spark jobs."""
