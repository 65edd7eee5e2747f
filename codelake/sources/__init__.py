"""Where rows come from: source trees, configuration, caches, providers of text, parsers."""
