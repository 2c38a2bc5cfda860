"""provloom: provenance and event-log analytics on PySpark."""
