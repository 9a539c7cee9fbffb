"""vulnlake: vulnerability-to-fix analytics as Spark jobs."""
