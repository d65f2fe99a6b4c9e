"""tidewatch: a PySpark engine for monitoring published web documents.

The package is split by role: ``functions`` holds Column expressions,
``operators`` DataFrame-to-DataFrame operators, ``sources`` readers and
sinks, ``plans`` whole queries with their SQL counterparts, ``streaming``
the keyed run state.  ``llm`` (optional, imported by nothing else) holds the
operators for preparing training text.
"""

__version__ = "0.1.0"
