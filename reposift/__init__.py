"""Spark-native analytics over issue-tracker and code-review data.

Sub-packages:

* ``functions`` - Column expressions (text, paths, dates, vectors, payloads)
* ``operators`` - DataFrame to DataFrame building blocks
* ``sources`` / ``sinks`` - tables and files in and out
* ``plans`` - whole jobs composed from the operators
* ``streaming`` - the same operators on Structured Streaming
"""
