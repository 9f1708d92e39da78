"""Interest profiling and evaluation over social timelines, as Spark DataFrame jobs."""
