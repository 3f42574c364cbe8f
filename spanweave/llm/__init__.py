"""spanweave.llm"""
