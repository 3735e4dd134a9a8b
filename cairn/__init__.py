"""cairn — a PySpark-native corpus engine.

Turns tables of files, pages, transcripts and conversations into a
selected, fingerprinted, de-duplicated and searchable corpus.  Every
operator is a plain ``DataFrame -> DataFrame`` function, so it composes with
``DataFrame.transform`` and leaves planning to Catalyst and AQE.
"""

__version__ = "0.1.0"
