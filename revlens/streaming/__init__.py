"""Incremental landing of store exports."""
