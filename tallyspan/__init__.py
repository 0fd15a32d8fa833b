"""Longitudinal-record analytics as Spark DataFrame functions."""
