"""Survey and geospatial analytics as Spark DataFrame operators."""
