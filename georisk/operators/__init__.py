"""georisk.operators"""
