"""DataFrame operators: documents, stations, classification, retrieval, live payloads, sessions, quality."""
