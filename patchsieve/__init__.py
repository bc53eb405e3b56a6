"""PySpark jobs for triaging changes to large collections of versioned files."""
