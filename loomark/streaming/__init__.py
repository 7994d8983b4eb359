"""loomark.streaming"""
