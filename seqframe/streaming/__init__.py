"""seqframe.streaming"""
