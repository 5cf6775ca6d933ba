"""corpuscle: a Spark-native engine for versioned document collections.

Sources, segmentation, incremental ingest, hybrid retrieval, graph expansion,
evaluation and interval analytics, all expressed as DataFrame plans.
"""

__version__ = "0.1.0"
