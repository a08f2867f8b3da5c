"""Document analytics on Spark: PDF files as tables, layout analysis and text sinks."""
