"""millrace: gzip sources, integrity checks and corpus operators as ordinary Spark jobs."""
