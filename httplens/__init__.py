"""httplens: analytics over captured HTTP traffic, written for PySpark."""
