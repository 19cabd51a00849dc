"""Event listings on Spark: raw listing feeds, dumps and pages to staged events."""
