"""Frame filtering, question mining and question-bank analytics as PySpark jobs."""
