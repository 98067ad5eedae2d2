"""Sources: readers with column aliases, and adapters of the test tables."""
