"""plumbline: data-quality and anomaly checks, and corpus preparation, as Spark plans."""
