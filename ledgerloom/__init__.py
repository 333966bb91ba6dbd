"""A PySpark engine for block- and event-indexed series."""
