"""corpuslink.operators"""
