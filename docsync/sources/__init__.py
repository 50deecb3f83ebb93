"""Where rows come from and where they go: file listings, snapshots, the error table."""
