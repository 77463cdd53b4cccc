"""Analytics over a firehose of short social posts, written for PySpark.

Every operator is a function from DataFrame to DataFrame.  The stream
analytics accept a batch or a streaming frame and give the same rows for both.
"""
