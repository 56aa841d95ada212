"""seqframe.operators"""
