"""sheaf: document extraction and text processing as Spark DataFrame jobs."""
