"""spanweave.sources"""
