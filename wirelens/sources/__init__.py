"""Readers, sinks, fitted-state tables, the synthetic generator and the test-table views."""
