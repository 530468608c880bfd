"""corpuslink.plans"""
