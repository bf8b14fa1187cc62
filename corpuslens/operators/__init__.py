"""DataFrame operators: corpus construction, diffs, retrieval, verdicts, statistics and models."""
