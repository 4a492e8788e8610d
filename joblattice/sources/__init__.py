"""Readers: landed payloads, web pages, crawl lists, stores."""
