"""Batch and streaming analytics over event logs, documents and transcripts, written for Spark."""
