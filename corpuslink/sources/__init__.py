"""corpuslink.sources"""
