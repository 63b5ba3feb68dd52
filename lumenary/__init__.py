"""Lumenary: document-evidence analytics expressed as PySpark DataFrame plans."""
