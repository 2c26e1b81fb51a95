"""Readers and writers of graphs, results and experiment tables."""
