"""seqlabel: curation, splitting, encoding, scoring and evaluation of
multi-label sequence tables, written as lazy Spark DataFrame jobs.

Every public operator is a pure function ``DataFrame -> DataFrame``; none
creates a session or collects unbounded data to the driver.
"""

__version__ = "0.1.0"
