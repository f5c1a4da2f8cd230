"""lemmaworks: a PySpark-native engine for retrieval corpora cut from marked-up technical papers."""

__version__ = "0.1.0"
