"""Readers: raw tables, contact tables, and raw tables derived from event logs."""
