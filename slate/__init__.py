"""slate: schedule-driven player projections as Spark DataFrame jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame ->
DataFrame building blocks), ``sources`` (scans and writes), ``plans``
(adapters, reports, ETL and the query registry) and ``streaming``
(incremental loads).
"""

__version__ = "0.1.0"
