"""seqframe.sources"""
