"""georisk.plans"""
