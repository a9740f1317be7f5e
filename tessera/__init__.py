"""Tessera: media and corpus analytics as PySpark DataFrame plans."""
