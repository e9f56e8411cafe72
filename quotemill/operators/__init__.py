"""quotemill.operators"""
