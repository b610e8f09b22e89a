"""Building, scoring and triaging crosswalks between code systems, on Spark."""
