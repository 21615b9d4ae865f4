"""clausemill.functions"""
