"""tonefold.operators"""
