"""opweave.plans"""
