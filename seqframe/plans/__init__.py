"""seqframe.plans"""
