"""Workloads and registered queries."""
