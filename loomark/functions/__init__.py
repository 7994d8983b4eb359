"""loomark.functions"""
