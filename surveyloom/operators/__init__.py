"""DataFrame operators: joins, ranks, reshaping and survey estimation."""
