"""Readers, writers, file catalogues and the adaptor for the test tables."""
