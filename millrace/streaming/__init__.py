"""Row-local steps over streams."""
