"""A news-analytics engine on Spark: rules, ranking, coverage grouping and editions as DataFrame plans."""
