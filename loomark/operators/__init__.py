"""loomark.operators"""
