"""quotemill.plans"""
