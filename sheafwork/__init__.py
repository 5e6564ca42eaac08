"""Document parsing, extraction and corpus preparation as Spark jobs."""
