"""Event-listing catalogs and shared-taste analytics as PySpark jobs."""
