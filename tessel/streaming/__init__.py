"""tessel.streaming"""
