"""quotemill.streaming"""
