"""quotemill.sources"""
