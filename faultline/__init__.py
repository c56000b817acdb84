"""faultline: log triage and corpus preparation as Spark jobs."""
