"""claravoz: survey-feedback cleaning, quality and analytics as Spark DataFrame jobs.

Every function takes a DataFrame (or a SparkSession) and returns a DataFrame
or a Column; none of them creates a session.
"""

__version__ = "0.1.0"
