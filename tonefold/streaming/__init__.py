"""tonefold.streaming"""
