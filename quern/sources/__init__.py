"""Where rows come from and go to: files, JDBC databases, and the snapshot store of mutable tables."""
