"""Spark jobs for signed invoice lines: contract, star schema, reconciliation, KPIs."""
