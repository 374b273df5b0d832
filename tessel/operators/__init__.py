"""tessel.operators"""
