"""rollweave.functions"""
