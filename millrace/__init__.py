"""millrace: batch key-value analytics over text, access logs and training corpora, on Spark."""
