"""tonefold.sources"""
