"""The stages: collect, guess, crawl, verify, export."""
