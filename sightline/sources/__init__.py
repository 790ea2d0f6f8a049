"""Where rows come from and go to: tables, content-addressed blobs, labelled files, recognised text."""
