"""georisk.streaming"""
