"""Primrose: text-sensitivity analytics as PySpark DataFrame operators.

Layout
------
``functions``  column expressions (no DataFrame, no shuffle)
``operators``  DataFrame -> DataFrame building blocks
``sources``    scans and sinks
``streaming``  the same operators on Structured Streaming
``plans``      end-to-end flows, and the queries registered for checking
"""

__version__ = "0.1.0"
