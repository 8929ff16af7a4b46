"""vetrina: catalogue import, data quality and lineage on Spark.

Every operator is a function from DataFrames to a DataFrame; the modules are

* ``sources``   -- file discovery, CSV scans, staging tables, reference data
* ``functions`` -- column expressions (normalisation, GTIN, numbers, text)
* ``operators`` -- mapping, validation, profiling, quality, resolution,
                   reshape/export, lineage
* ``plans``     -- fixtures derived from the driver tables and the registered
                   queries with their SQL oracles
* ``streaming`` -- Structured Streaming twins of the event-driven parts
"""

__all__ = ["session"]
