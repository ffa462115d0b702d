"""DataFrame operators keyed by ``(file_id, stream_index)``."""
