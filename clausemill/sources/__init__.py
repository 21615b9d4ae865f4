"""clausemill.sources"""
