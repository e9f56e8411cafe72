"""quotemill.functions"""
