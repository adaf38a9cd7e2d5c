"""opweave.operators"""
