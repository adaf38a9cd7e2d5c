"""opweave.streaming"""
