"""DataFrame -> DataFrame operators: preparation, evaluation, statistics, reports."""
