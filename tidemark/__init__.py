"""tidemark: a content-intelligence engine written as PySpark DataFrame operators."""
