"""rollweave.plans"""
