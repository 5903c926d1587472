"""quillspark: a Spark-native data-validation and retail-insight engine.

Every operator is a ``DataFrame -> DataFrame`` function.  Nothing is pulled
to the driver except one-row statistics and small top-N results.
"""

__version__ = "0.1.0"
