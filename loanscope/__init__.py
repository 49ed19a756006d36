"""loanscope: Spark-native pricing and risk analytics over loan portfolios.

Every operator is a ``DataFrame -> DataFrame`` function whose loan-grain work
runs as Spark jobs (scans, joins, aggregates, windows).  Only summary rows
(one row per grade, segment or arm) ever reach closed-form Python helpers.
"""

__version__ = "0.1.0"
