"""Query compiler and batch pipelines."""
