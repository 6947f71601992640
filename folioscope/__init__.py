"""folioscope: document-structure and corpus-integrity analytics on PySpark."""

__version__ = "0.1.0"
