"""Entity analytics over large text corpora, expressed as Spark jobs."""
