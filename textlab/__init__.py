"""textlab: Spark-native operators for building, scoring and evaluating labelled text.

Every public operator takes and returns DataFrames (or Columns) and runs on
the JVM side: no Python UDF is used by any operator in this package.
"""

__version__ = "0.1.0"
