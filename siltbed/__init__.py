"""siltbed: content-inventory analytics and training-data operators on PySpark."""
