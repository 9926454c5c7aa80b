"""Dossier: a PySpark-native engine for auditing document corpora and the judgments made about them."""
