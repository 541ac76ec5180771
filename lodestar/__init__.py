"""Open-set, few-shot, class-incremental classification and corpus preparation on Spark."""
