"""tonefold.plans"""
