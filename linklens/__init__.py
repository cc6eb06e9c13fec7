"""linklens: Spark-native analytics over tables of news-article links.

Every operator is a function from DataFrame(s) to a DataFrame built from
built-in Spark SQL expressions, aggregates, joins and windows, so Catalyst
can prune, push down and plan it; only Spark ML fits and the caller-supplied
batch scorer leave the JVM.
"""

__version__ = "0.1.0"
