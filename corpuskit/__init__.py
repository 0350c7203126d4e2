"""corpuskit: Q&A corpus preparation and model-evaluation analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing whole is
collected to the driver.  See README.md for the operator map.
"""

__version__ = "0.1.0"
