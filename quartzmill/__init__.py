"""quartzmill: a PySpark engine for wide, sparse, imbalanced classification data."""

__version__ = "0.1.0"
