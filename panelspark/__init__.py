"""Panel analytics on Spark: panels, contrasts and fixed-effect regressions as DataFrame jobs."""
