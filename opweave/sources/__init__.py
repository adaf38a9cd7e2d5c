"""opweave.sources"""
