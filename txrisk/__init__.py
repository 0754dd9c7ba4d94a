"""txrisk: transaction-risk analytics as plain Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from native
Spark expressions, so the same code serves batch jobs and Structured
Streaming queries and Catalyst plans the whole chain at once.
"""

__version__ = "0.1.0"
