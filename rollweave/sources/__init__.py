"""rollweave.sources"""
