"""Contest analytics as Spark jobs: plays in, sides, contests and studies out."""
