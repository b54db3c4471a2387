"""Where rows come from: recorded logs, live topics, catalog tables."""
