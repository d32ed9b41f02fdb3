"""A PySpark engine that builds and analyses text-to-sequence corpora."""
