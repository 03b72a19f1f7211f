from .live import outcomes, rejected_stream, route_outcomes, route_stream, stream_replies  # noqa: F401
