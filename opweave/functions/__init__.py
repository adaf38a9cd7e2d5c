"""opweave.functions"""
