"""attrix — a Spark-native business-analytics engine.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, window functions, MLlib estimators or grouped pandas
jobs.  Nothing is collected to the driver except bounded scalars (period
boundaries, model coefficients, a handful of totals).
"""

__version__ = "0.1.0"
