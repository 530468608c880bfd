"""corpuslink.functions"""
