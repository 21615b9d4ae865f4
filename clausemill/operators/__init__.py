"""clausemill.operators"""
