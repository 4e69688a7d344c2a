"""Spark jobs for audit-log lakes: load, lay out, register, and watch."""
