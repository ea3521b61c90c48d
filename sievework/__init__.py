"""Curation, validation, sampling and scoring of structured-output text on Spark."""
