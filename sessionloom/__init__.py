"""End-of-day market panel analytics expressed as Spark DataFrame transforms."""
