"""Spatio-temporal evidence on Spark."""
