"""georisk.sources"""
