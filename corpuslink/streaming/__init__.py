"""corpuslink.streaming"""
