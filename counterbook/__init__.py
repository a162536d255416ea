"""counterbook: retail back-office analytics as Spark jobs.

Operators (``counterbook.operators``) are functions from DataFrames to
DataFrames built from Spark SQL functions; ``counterbook.api.BackOffice``
runs them over a folder of back-office tables; ``counterbook.plans`` holds
the driver queries and their DuckDB oracles.
"""

__version__ = "0.1.0"
