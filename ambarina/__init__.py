"""Ambarina: PySpark-native analytics over collections of nested, coded dialogue documents.

Every public operator is a function from DataFrame(s) to a DataFrame; nothing here keeps a global session.
"""

__version__ = "0.1.0"
