"""Runnable queries: the operators applied to the given tables."""


def load() -> None:
    """Import every query module so that it registers its queries."""
    from importlib import import_module
    for m in ("text_queries", "article_queries", "signal_queries", "price_queries", "stream_queries"):
        import_module(f"{__name__}.{m}")
