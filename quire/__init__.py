"""quire: analytics over PDF files and training text on Apache Spark."""
