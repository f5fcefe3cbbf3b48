"""rollweave.operators"""
