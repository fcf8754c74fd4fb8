from lapse.streaming.ingest import ingest_incremental, ingest_stream  # noqa: F401
