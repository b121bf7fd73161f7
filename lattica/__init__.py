"""lattica: observation x variable analytics over long Spark tables."""
