"""spanweave.operators"""
