"""Scalar building blocks: functions from Columns to Columns."""
