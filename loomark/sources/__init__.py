"""loomark.sources"""
