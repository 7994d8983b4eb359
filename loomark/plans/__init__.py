"""loomark.plans"""
