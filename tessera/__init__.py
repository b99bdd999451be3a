"""Transcript and coding analytics as Spark DataFrame operators."""
