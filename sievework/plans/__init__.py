"""Whole flows, and the queries that exercise every operator."""
