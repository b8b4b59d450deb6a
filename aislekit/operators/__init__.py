"""DataFrame operators: catalog, sampling, contexts, chat, retrieval, replies, metrics."""
