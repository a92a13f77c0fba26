"""Spark library for identity-document text: regions in, typed tables out."""
