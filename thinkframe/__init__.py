"""thinkframe: reasoning-corpus preparation and evaluation analytics on Spark.

Every public function takes and returns Spark ``Column`` or ``DataFrame``
objects; the work runs as Spark SQL expressions, joins, aggregations,
windows and Structured Streaming queries.
"""

__version__ = "0.1.0"
