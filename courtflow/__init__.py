"""courtflow: court-sport tracking analytics as Spark DataFrame operators."""
