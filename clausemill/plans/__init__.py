"""clausemill.plans"""
