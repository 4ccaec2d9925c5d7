"""scorewise: tabular scoring analytics on Spark DataFrames and Spark ML.

Operators are plain ``DataFrame -> DataFrame`` functions (use them with
``df.transform``); see ``scorewise.operators``.
"""

__version__ = "0.1.0"
