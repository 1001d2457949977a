"""tonefold.functions"""
