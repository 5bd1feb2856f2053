"""Web-server access-log forensics as Spark DataFrame operations."""
