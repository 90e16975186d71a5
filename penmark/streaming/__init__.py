"""Row-local features on a stream."""
