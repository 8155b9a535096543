"""A versioned knowledge graph as Spark DataFrames: ingest, query, mine, measure."""
